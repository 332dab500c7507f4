from grainmill.cli import main

main()
