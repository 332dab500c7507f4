"""Prepared inputs of the queries, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.signals import ATOMIC, FIELDS, ORDINAL, SQL_ORDINALS, SQL_SCALARS, decode
from grainmill.operators.identity import first_seen, with_identity
from grainmill.operators.utility import apply_utilities, fit, spec_of
from grainmill.sources.shared import cut
from grainmill.sources.tables import PATH_DOMAIN, domain_of, table


def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "q1", "row_key", "id", "_source_domain", "_source_path", "source_label", *FIELDS)
    return with_identity(df, domain_of(F.col("_source_domain"), F.col("_source_path")))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique records with their 25 scalars and alternative ordinals: uid, row_key, domain, membership, a1."""
    one = first_seen(q1(spark, sf_dir).drop("_source_domain", "_source_path", "signature"))
    one = one.withColumn("a1", F.array_contains(F.split("membership", ";"), "A1"))
    return decode(one, ["uid", "row_key", "id", "domain", "membership", "a1"], with_ordinal=True)


_kept: dict[tuple, object] = {}


def kept(spark: SparkSession, sf_dir: str, name: str, make):
    """What ``make`` gives, once a session for the tables of ``sf_dir`` as they are: a changed file or folder makes it anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = tuple(sorted((str(f.getPath()), f.getLen(), f.getModificationTime()) for f in fs.listStatus(path)))
    key = (spark.sparkContext.applicationId, name, files)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def fitted_records(spark: SparkSession, sf_dir: str):
    """The unique records (cut), and what was fitted on those of A1."""

    def make():
        rows = cut(records(spark, sf_dir))
        return rows, fit(rows.where("a1"), "domain", "row_key")

    return kept(spark, sf_dir, "fit", make)


ORDINALS = [f"o_{f}" for f in ORDINAL]


def utilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utilities of the unique records (cut), with the ordinals as alternatives to those of the four model ratings."""

    def make():
        rows, fitted = fitted_records(spark, sf_dir)
        return cut(apply_utilities(rows, "domain", fitted, ["uid", "row_key", "domain", "membership", "a1", "rps_doc_word_count", *ORDINALS]))

    return kept(spark, sf_dir, "utilities", make)


# SQL -------------------------------------------------------------------------------------------------------------------
DOMAIN = f"coalesce(nullif(lower(trim(_source_domain)), ''), nullif(lower(regexp_extract(_source_path, '{PATH_DOMAIN}', 1)), ''))"
SIGNALS = "concat_ws('~', " + ", ".join(f"coalesce(CAST({f} AS VARCHAR), '-')" for f in FIELDS) + ")"
Q1 = f"q AS (SELECT *, {DOMAIN} AS domain, {SIGNALS} AS sig FROM q1), q1x AS (SELECT *, concat_ws('|', coalesce(domain, ''), coalesce(id, ''), sig) AS rec FROM q)"
RECORDS = f"""{Q1}, member AS (SELECT rec, string_agg(DISTINCT source_label, ';' ORDER BY source_label) AS membership FROM q1x GROUP BY rec),
one AS (SELECT * FROM q1x QUALIFY row_number() OVER (PARTITION BY rec ORDER BY source_label, row_key) = 1),
r AS (SELECT one.row_key, one.id, one.domain, m.membership, contains(m.membership, 'A1') AS a1, {SQL_SCALARS}, {SQL_ORDINALS} FROM one JOIN member m ON m.rec = one.rec)"""


def _long(names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT row_key, domain, '{c}' AS col, {c} AS x FROM ref" for c in names)


LOGS = [c for c in ATOMIC if spec_of(c).get("log1p")]
#: Weighted quantiles of all columns of the reference (table ref: row_key, domain, a column each) as f(col, p, v).
FIT = f"""ref0 AS (SELECT * FROM r WHERE a1), sz AS (SELECT domain, count(*) AS n FROM ref0 GROUP BY domain),
ref AS (SELECT ref0.*, {', '.join(f'CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END AS log1p_{c}' for c in LOGS)} FROM ref0),
wt AS (SELECT domain, 1::DOUBLE / (count(*) OVER () * n) AS w FROM sz),
l AS (SELECT l0.*, wt.w FROM ({_long(list(ATOMIC) + [f'log1p_{c}' for c in LOGS])}) l0 JOIN wt ON wt.domain IS NOT DISTINCT FROM l0.domain WHERE x IS NOT NULL),
cw AS (SELECT col, x, (sum(w) OVER (PARTITION BY col ORDER BY x, row_key ROWS UNBOUNDED PRECEDING) - w / 2) / sum(w) OVER (PARTITION BY col) AS pos,
       row_number() OVER (PARTITION BY col ORDER BY x, row_key) AS k FROM l),
nx AS (SELECT *, lead(pos) OVER (PARTITION BY col ORDER BY k) AS pos2, lead(x) OVER (PARTITION BY col ORDER BY k) AS x2 FROM cw),
f AS (SELECT col, p, CASE WHEN k = 1 AND pos > p THEN x WHEN pos2 IS NULL THEN x ELSE x + (x2 - x) * (p - pos) / (pos2 - pos) END AS v
      FROM nx, (SELECT unnest([0.01, 0.05, 0.5, 0.95, 0.99])::DOUBLE AS p) WHERE (pos <= p AND (pos2 > p OR pos2 IS NULL)) OR (k = 1 AND pos > p)),
dm AS (SELECT domain, col, quantile_cont(x, 0.5) AS m FROM l GROUP BY domain, col)"""


def _get(col: str, p: float) -> str:
    return f"(SELECT v FROM f WHERE col = '{col}' AND p = {p}::DOUBLE)"


def sql_imputed(c: str) -> str:
    return f"coalesce(r.{c}, d.{c}, {_get(c, 0.5)}, 0)"


def sql_utility(c: str) -> str:
    s, x = spec_of(c), f"i.{c}"
    kind = s["kind"]
    if s.get("log1p"):
        x = f"ln(1 + greatest({x}, 0))"
    name = f"log1p_{c}" if s.get("log1p") else c
    if kind == "identity":
        e = f"greatest(0, least(1, {x}))"
    elif kind == "fixed_positive":
        lo, hi = s["bounds"]
        e = f"greatest(0, least(1, ({x} - {lo}::DOUBLE) / {hi - lo}::DOUBLE))"
    elif kind in ("reference_positive", "reference_negative"):
        e = f"CASE WHEN b.hi_{c} - b.lo_{c} < 1e-12 THEN 0.5::DOUBLE ELSE greatest(0, least(1, ({x} - b.lo_{c}) / (b.hi_{c} - b.lo_{c}))) END"
        e = f"1 - ({e})" if kind == "reference_negative" else e
    elif kind == "reference_interval":
        e = f"exp(-power((greatest(b.lo_{c} - {x}, 0) + greatest({x} - b.hi_{c}, 0)) / greatest((b.hi_{c} - b.lo_{c}) / 2, 1e-6), 2))"
    else:
        t = "CASE " + " ".join(f"WHEN i.domain = '{d}' THEN {v}::DOUBLE" for d, v in s["by_domain"].items()) + f" ELSE {s['tolerance']}::DOUBLE END"
        e = f"exp(-power(greatest({x} - ({t}), 0) / greatest((1 - ({t})) / 2, 1e-6), 2))"
    if s.get("neutral"):
        e = f"CASE WHEN i.domain IN ({', '.join(map(repr, s['neutral']))}) THEN 0.5::DOUBLE ELSE {e} END"
    del name
    return e


_EMPIRICAL = [c for c in ATOMIC if spec_of(c)["kind"].startswith("reference")]
_BOUNDS = ", ".join(
    f"{_get(('log1p_' if spec_of(c).get('log1p') else '') + c, p)} AS {side}_{c}" for c in _EMPIRICAL for side, p in zip(("lo", "hi"), spec_of(c).get("quantiles", (0.01, 0.99)))
)
_DOMAIN_MEDIANS = "dmw AS (SELECT domain, " + ", ".join(f"max(m) FILTER (WHERE col = '{c}') AS {c}" for c in ATOMIC) + " FROM dm GROUP BY domain)"
_Z = ", ".join("(u_qurater_0 + u_qurater_1 + u_qurater_2 + u_qurater_3) / 4 AS z_qurater" if f == "qurater" else f"u_{f} AS z_{f}" for f in FIELDS)
_VALID = " + ".join("(qurater_0 IS NOT NULL)::INT" if f == "qurater" else f"({f} IS NOT NULL)::INT" for f in FIELDS)
#: u(row_key, domain, membership, a1, words, valid_coverage, u_*) and z(... z_*).
UTILITIES = f"""{RECORDS}, {FIT}, {_DOMAIN_MEDIANS}, b AS (SELECT {_BOUNDS}),
i AS (SELECT r.row_key, r.domain, r.membership, r.a1, r.rps_doc_word_count AS words, {", ".join("r." + o for o in ORDINALS)}, ({_VALID.replace('(qurater_0', '(r.qurater_0')}) / 22::DOUBLE AS valid_coverage, {', '.join(f'{sql_imputed(c)} AS {c}' for c in ATOMIC)}
      FROM r LEFT JOIN dmw d ON d.domain IS NOT DISTINCT FROM r.domain),
u AS (SELECT i.row_key, i.domain, i.membership, i.a1, i.words, {", ".join("i." + o for o in ORDINALS)}, i.valid_coverage, {', '.join(f'{sql_utility(c)} AS u_{c}' for c in ATOMIC)} FROM i, b),
z AS (SELECT *, {_Z} FROM u)"""
UTILITIES = UTILITIES.replace(f"({_VALID.replace('(qurater_0', '(r.qurater_0')})", "(" + " + ".join("(r.qurater_0 IS NOT NULL)::INT" if f == "qurater" else f"(r.{f} IS NOT NULL)::INT" for f in FIELDS) + ")")
MASKS = """LATERAL (SELECT unnest(list_filter([CASE WHEN contains(membership, 'A1') THEN 'A1' END, CASE WHEN contains(membership, 'A2') THEN 'A2' END, CASE WHEN contains(membership, 'A3') THEN 'A3' END,
  CASE WHEN contains(membership, 'A2') AND NOT contains(membership, 'A1') THEN 'A2_new' END, CASE WHEN contains(membership, 'A3') AND NOT contains(membership, 'A1') THEN 'A3_new' END, 'union'], lambda x: x IS NOT NULL)) AS dataset) AS m(dataset)"""
