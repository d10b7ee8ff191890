"""Secret scan with multipart credential linking, in DataFrame functions alone.

Base patterns find assigned secrets, access identifiers and long hexadecimal runs.
Weaker parts (named identifiers, short or loosely named secrets, endpoints) are reported
only where complementary parts of the same document have at most ``SCOPE`` characters between
them: an identifier or endpoint beside a secret, a secret beside an identifier or endpoint.

A pattern's matches and the pieces between them come as two arrays; offsets are running
sums of their lengths. The matches become rows, are shuffled once by a row number, and
an interval join of each part with the other roles in its scope is a comparison with the
greatest end before it and the least start after it, running over the document's parts. Work
is linear in a document's parts but for sorting them.

Defined results: a null text is an empty one without secrets; repeated rows give
repeated rows, null or repeated ids included; an empty table gives an empty one; other
columns are left out. Spans at one start go by kind, then end; parts that overlap are beside
each other, and a part may link any number of others. Texts of any length are scanned whole;
no document meets another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitpanel.llm.common import id_and_text

SCOPE = 200
VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
NAMES = "password|passwd|secret|token|api_?key"

#: kind, role, whether base, a plain character sequence it can't do without (any of), pattern.
PARTS = [
    ("assign", "secret", True, "=:", f"(?i)({NAMES}){VALUE}"),
    ("access", "id", True, ["AKIA"], "AKIA[A-Z0-9]{14,}"),
    ("hex", "secret", True, [], "[0-9a-f]{16,}"),
    ("id", "id", False, "=:", r"""(?i)(access|client|account|user|login)[_-]?(key_id|id|name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}"""),
    ("key", "secret", False, "=:", f"(?i)(pwd|pass|auth|credential|private_?key|{NAMES}){VALUE}"),
    ("endpoint", "endpoint", False, ["://"], r"""(?i)(https?|ftp|ssh|jdbc|postgres|postgresql|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]+"""),
]
KINDS = [kind for kind, *_ in PARTS]


def passes(kind: str, pattern: str, match: Column) -> Column:
    """The test of a match; a match that fails it still takes up its place."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, pattern, 2)) >= 12
    if kind == "key":
        n = F.length(F.regexp_extract(match, pattern, 2))
        return (n >= 6) & ((n < 12) | ~match.rlike(f"(?i)^({NAMES})"))
    return F.lit(True)


def part_rows(text: Column, number: int) -> Column:
    """An array of (kind number, place, characters before, characters, passes) of one kind."""
    kind, _, _, needs, pattern = PARTS[number]
    empty = F.array().cast("array<struct<kind:int,at:int,gap:int,size:int,good:boolean>>")
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("p")),
        lambda x, k: F.struct(
            F.lit(number).alias("kind"), k.alias("at"), F.length(x["p"]).alias("gap"), F.length(x["m"]).alias("size"),
            passes(kind, pattern, x["m"]).alias("good"),
        ),
    )
    some = F.lit(True) if not needs else F.lit(False)
    for held in needs:
        some = some | text.contains(held)
    return F.when(some & text.rlike(pattern), rows).otherwise(empty)


def find(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: kind number, start and exclusive end in code points, base or not."""
    rows = id_and_text(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.concat(*(part_rows(F.col("text"), k) for k in range(len(PARTS))))
    each = rows.select("row", "doc_id", F.explode_outer(parts).alias("part")).select("row", "doc_id", "part.*").repartition("row")
    before = Window.partitionBy("row", "kind").orderBy("at")
    placed = each.withColumn("start", F.sum(F.col("gap").cast("bigint") + F.col("size")).over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    kinds = {role: [k for k, (_, r, *_) in enumerate(PARTS) if r == role] for role in ("id", "secret", "endpoint")}
    placed = placed.withColumn("end", F.col("start") + F.col("size"))
    # A part is beside another if at most ``scope`` characters stand between them: one that begins
    # earlier and ends late enough, or one that begins not later than the scope after the end.
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = {role: F.max(F.when(F.col("good") & F.col("kind").isin(numbers), F.col("end"))).over(before) for role, numbers in kinds.items()}
    after = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    next_ = {role: F.min(F.when(F.col("good") & F.col("kind").isin(numbers), F.col("start"))).over(after) for role, numbers in kinds.items()}
    beside = {role: F.coalesce(reach[role] >= F.col("start") - scope, F.lit(False)) | F.coalesce(next_[role] <= F.col("end") + scope, F.lit(False)) for role in kinds}
    linked = placed.select("*", *(c.alias(f"with_{role}") for role, c in beside.items()))
    base = F.col("kind") <= 2
    kept = F.col("good") & (base | F.when(F.col("kind").isin(kinds["secret"]), F.col("with_id") | F.col("with_endpoint")).otherwise(F.col("with_secret")))
    span = F.struct(F.col("start").cast("int").alias("start"), F.col("kind"), F.col("end").cast("int").alias("end"))
    return linked.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(kept, span))).alias("spans")).drop("row")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def count(number: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("bigint").alias(f"n_{KINDS[number]}")


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("spans", lambda s: s["kind"] <= 2)
    return found.select("doc_id", *map(count, range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql() -> str:
    raw = []
    for k, (_, _, _, _, pattern) in enumerate(PARTS):
        p = pattern.removeprefix("(?i)").replace("'", "''")
        flag = "'i'" if pattern.startswith("(?i)") else "''"
        raw.append(f"SELECT r, {k} AS kind, regexp_extract_all(t, '{p}', 0, {flag}) AS m, string_split_regex(t, '{p}', {flag}) AS p FROM d")
    value = VALUE.replace("'", "''")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({' UNION ALL '.join(raw)}),
each AS (SELECT r, kind, unnest(m) AS m, unnest(p[1:len(m)]) AS p, unnest(range(len(m))) AS i FROM raw),
placed AS (SELECT r, kind, m, CAST(sum(length(p) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS e,
                  length(regexp_extract(m, '({NAMES}|pwd|pass|auth|credential|private_?key){value}', 2, 'i')) AS n FROM each),
good AS (SELECT r, kind, e - length(m) AS s, e FROM placed
         WHERE CASE kind WHEN 0 THEN n >= 12 WHEN 4 THEN n >= 6 AND (n < 12 OR NOT regexp_matches(m, '^({NAMES})', 'i')) ELSE true END),
role AS (SELECT *, CASE kind WHEN 1 THEN 'i' WHEN 3 THEN 'i' WHEN 5 THEN 'e' ELSE 's' END AS role FROM good),
kept AS (SELECT * FROM role a WHERE kind <= 2 OR EXISTS (SELECT 1 FROM role b WHERE b.r = a.r AND b.s <= a.e + {SCOPE} AND b.e >= a.s - {SCOPE}
         AND CASE a.role WHEN 's' THEN b.role <> 's' ELSE b.role = 's' END)),
out AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
               string_agg(([{', '.join(repr(k) for k in KINDS)}])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
               string_agg(([{', '.join(repr(k) for k in KINDS)}])[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind <= 2) AS base
        FROM kept GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN out ON out.r = d.r
"""


SQL = _sql()
