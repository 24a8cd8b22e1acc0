r"""Secret scans with multipart credential linking, DataFrame functions only.

Strong candidates stand by themselves: assignments of a secret word, access ids and long
hexadecimal runs (``PATTERNS``, group 2 or the match long enough).  Weak candidates are logins,
short-named assignments, mixed-case blobs and endpoints, which ordinary text holds as well; one is
reported only where a complementary part of a credential is less than ``REACH`` code points
away in the same scope: a secret beside a login, an access id or an endpoint, or the reverse.
A scope is what blank lines enclose.  Weak candidates that touch a strong one are parts of it and go.

How: a single pass tells which texts can hold anything; equal texts of these are worked on once.
Gaps and matches of a pattern give lengths by turns, so a window's running sum over them gives
places, and the running count of blank lines the scope; parts are cut at bins of ``REACH`` code
points, and complementary ones meet by an equi-join on text, scope and bin.  What a
bin holds is bounded by its width, and a pair is counted in the first bin alone that both touch.
Spans are gathered by text, of which every one was a row of the input, and joined to the documents
by the text's sha256, salted, so that copies of one text are spread over tasks.

Defined cases: a null text is empty and has no spans; places are code points, ends exclusive;
a null id keeps its row, and equal rows are rows of their own; an empty table gives no rows;
other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

REACH, SALTS = 200, 16

# Strong kinds, their patterns, and the least length of what counts.
STRONG = ("assign", "access", "hex")
WORDS = ("password", "passwd", "secret", "token", "api_?key")
LEAST = {"assign": 6, "access": 20, "hex": 24}


def either_case(word: str) -> str:
    """ASCII letters of a pattern in either case, in the syntax of all engines."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


def assigned(words: tuple[str, ...]) -> str:
    """The pattern of a name, a sign of assignment, and what opens the value."""
    return f"(?:{'|'.join(map(either_case, words))})" + r"""["']?\x20*[:=]\x20*["']?"""


HEAD = assigned(WORDS)
PATTERNS = {
    "assign": HEAD + "[A-Za-z0-9+/_.=-]+",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "login": assigned(("user_?name", "user_?id", "user", "login", "account", "client_?id", "access_?key_?id")) + "[A-Za-z0-9+/_.@=-]{3,}",
    "phrase": assigned(("pwd", "passphrase", "pass", "key", "auth", "credential")) + "[A-Za-z0-9+/_.=-]{6,}",
    "blob": "[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?:https?|ftp|sftp|ssh|amqp|redis|mysql|mongodb|postgres|postgresql)://[^\x20\x09-\x0D"'<>]+""",
    "break": r"\n[\x20\x09\x0D]*\n",
}
KINDS = tuple(k for k in PATTERNS if k != "break")
SECRETS = ("assign", "hex", "phrase", "blob")
SPANS = "array<struct<kind:string,start:int,end:int>>"

#: What a text needs to hold for a span to be possible: a strong one, or a weak secret beside a login or an endpoint.
_strong = f"{PATTERNS['assign']}|AKIA[A-Z0-9]{{16}}|[0-9a-f]{{24}}"
_others = f"{PATTERNS['login']}|{PATTERNS['endpoint']}"


def may_hold(text: Column) -> Column:
    weak = f"{PATTERNS['phrase']}|{PATTERNS['blob']}"
    return text.rlike(_strong) | (text.rlike(_others) & text.rlike(weak))


def holds(kind: Column, found: Column) -> Column:
    """Whether a match is long and mixed enough for its kind."""
    value = F.regexp_replace(found, f"^{HEAD}", "")
    mixed = found.rlike("[a-z]") & found.rlike("[A-Z]") & found.rlike("[0-9]")
    return (
        F.when(kind == "assign", F.length(value) >= LEAST["assign"]).when(kind == "access", F.length(found) >= LEAST["access"])
        .when(kind == "hex", F.length(found) >= LEAST["hex"]).when(kind == "blob", mixed).otherwise(True)
    )


def _measured(kind: str) -> Callable[[Column], Column]:
    return lambda found: F.struct(F.length(found).alias("n"), holds(F.lit(kind), found).alias("holds"))


def candidates(texts: DataFrame) -> DataFrame:
    """(key, kind, start, end, scope) of all matches that hold, strong or weak, for rows (key, t) of different keys."""
    turns = []
    for kind, pattern in PATTERNS.items():
        # lengths by turns: gap and match, and a last gap that nothing follows
        found = F.transform(F.regexp_extract_all("t", F.lit(pattern), F.lit(0)), _measured(kind))
        gaps = F.transform(F.split("t", pattern, -1), lambda g: F.length(g))
        turns.append(F.when(F.size(found) > 0, F.struct(F.lit(kind).alias("kind"), found.alias("found"), F.slice(gaps, F.lit(1), F.size(found)).alias("gaps"))))
    # struct by struct, not field by field: each pattern is looked for once
    rows = texts.select("key", F.explode(F.filter(F.array(*turns), lambda x: x.isNotNull())).alias("x")).select("key", "x.kind", F.posexplode(F.arrays_zip("x.gaps", "x.found")).alias("pos", "m"))
    so_far = Window.partitionBy("key", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.select("key", "kind", F.sum(F.col("m.gaps") + F.col("m.found.n")).over(so_far).cast("int").alias("end"), F.col("m.found.n").alias("n"), F.col("m.found.holds").alias("holds"))
    placed = placed.filter("holds").select("key", "kind", (F.col("end") - F.col("n")).alias("start"), "end")
    scope = F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("scope", scope.cast("int")).filter("kind <> 'break'")


def apart(spans: DataFrame) -> DataFrame:
    """Without weak spans that touch a strong one: the nearest strong starts and ends around each, by running extremes."""
    strong = F.col("kind").isin(*STRONG)
    before = Window.partitionBy("key").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("key").orderBy(F.col("start").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # of equal starts the strong ones overlap as well: they are in the first window, whatever their order
    touched = (F.coalesce(F.max(F.when(strong, F.col("end"))).over(before), F.lit(0)) > F.col("start")) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    return spans.withColumn("touched", touched).filter(strong | ~F.col("touched")).drop("touched")


def credentials(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of complementary parts within reach: (key, scope, secret_kind, secret_start, secret_end, part_kind, part_start, part_end)."""
    side = lambda prefix: [F.col(c).alias(f"{prefix}_{c}") for c in ("key", "scope", "kind", "start", "end")]
    width = F.lit(reach)
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor((b - 1) / width)))
    secrets = spans.filter(F.col("kind").isin(*SECRETS)).select(*side("secret"), F.greatest(F.lit(0), F.col("start") - width).alias("from"), (F.col("end") + width).alias("to"))
    secrets = secrets.select("*", bins(F.col("from"), F.col("to")).alias("secret_bin"))
    parts = spans.filter(~F.col("kind").isin(*SECRETS)).select(*side("part"), bins(F.col("start"), F.col("end")).alias("part_bin"))
    same = (F.col("secret_key") == F.col("part_key")) & (F.col("secret_scope") == F.col("part_scope")) & (F.col("secret_bin") == F.col("part_bin"))
    near = (F.col("part_start") < F.col("to")) & (F.col("part_end") > F.col("from"))
    first = F.col("secret_bin") == F.floor(F.greatest("from", "part_start") / width)
    met = secrets.join(parts, same & near & first)
    return met.select(F.col("secret_key").alias("key"), F.col("secret_scope").alias("scope"), "secret_kind", "secret_start", "secret_end", "part_kind", "part_start", "part_end")


def linked(spans: DataFrame, reach: int = REACH) -> DataFrame:
    """Strong spans, and weak ones that are part of a credential."""
    pairs = credentials(spans, reach)
    ends = pairs.select("key", F.explode(F.array(*[F.struct(*[F.col(f"{side}_{c}").alias(c) for c in ("kind", "start", "end")]) for side in ("secret", "part")])).alias("x")).select("key", "x.*")
    strong = F.col("kind").isin(*STRONG)
    return spans.filter(strong).select("key", "kind", "start", "end").unionByName(ends.filter(~strong).distinct())


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(doc_id, spans) for every row: its spans (kind, start, end) by start, then kind as listed."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), t.alias("t")).withColumn("may", may_hold(F.col("t")))
    # rows that hold nothing meet nothing; a key of their own spreads them
    number = F.monotonically_increasing_id()
    key = F.when(F.col("may"), F.sha2("t", 256)).otherwise(F.concat(F.lit("-"), number.cast("string")))
    kept = rows.select("doc_id", key.alias("d_key"), F.pmod(number, F.lit(SALTS)).cast("int").alias("d_salt"), F.when(F.col("may"), F.col("t")).alias("t"))
    seen, _ = written(kept, "secret-texts")
    texts = seen.filter("t is not null").groupBy(F.col("d_key").alias("key")).agg(F.first("t").alias("t"))
    found, _ = written(apart(candidates(texts)), "secret-spans")
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), "end", "kind")
    by_text = linked(found, reach).groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    by_text = by_text.select("key", F.transform("all", lambda s: F.struct(s.kind.alias("kind"), s.start.alias("start"), s.end.alias("end"))).alias("found"))
    by_text = by_text.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = seen.select("doc_id", "d_key", "d_salt").join(by_text, (F.col("d_key") == F.col("key")) & (F.col("d_salt") == F.col("salt")), "left")
    return joined.select("doc_id", F.coalesce("found", F.array().cast(SPANS)).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s.kind.isin(*STRONG))
    return found.select("doc_id", *map(count, STRONG), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def sql() -> str:
    q = {k: p.replace("'", "''") for k, p in PATTERNS.items()}
    parts = "\nUNION ALL ".join(f"SELECT r, '{k}' AS kind, regexp_extract_all(t, '{p}') AS found, string_split_regex(t, '{p}') AS gaps FROM d" for k, p in q.items())
    ranks = ", ".join(f"'{k}'" for k in KINDS)
    strong, secrets = (", ".join(f"'{k}'" for k in x) for x in (STRONG, SECRETS))
    head = HEAD.replace("'", "''")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({parts}),
e AS (SELECT r, kind, unnest(range(1, len(found) + 1)) AS i, unnest(found) AS f, unnest(gaps[1:len(found)]) AS g FROM m WHERE len(found) > 0),
p AS (SELECT *, (sum(length(g) + length(f)) OVER (PARTITION BY r, kind ORDER BY i))::INTEGER AS "end" FROM e),
h AS (SELECT r, kind, "end" - length(f) AS start, "end" FROM p
  WHERE CASE kind WHEN 'assign' THEN length(regexp_replace(f, '^{head}', '')) >= 6 WHEN 'access' THEN length(f) >= 20 WHEN 'hex' THEN length(f) >= 24
             WHEN 'blob' THEN regexp_matches(f, '[a-z]') AND regexp_matches(f, '[A-Z]') AND regexp_matches(f, '[0-9]') ELSE true END),
s AS (SELECT a.*, (SELECT count(*) FROM h b WHERE b.r = a.r AND b.kind = 'break' AND b.start <= a.start) AS scope, kind IN ({strong}) AS strong, kind IN ({secrets}) AS secret FROM h a WHERE kind <> 'break'),
o AS (SELECT * FROM s a WHERE strong OR NOT EXISTS (SELECT 1 FROM s b WHERE b.r = a.r AND b.strong AND b.start < a."end" AND b."end" > a.start)),
l AS (SELECT * FROM o a WHERE strong OR EXISTS (SELECT 1 FROM o b WHERE b.r = a.r AND b.scope = a.scope AND a.secret <> b.secret AND b.start < a."end" + {REACH} AND b."end" > a.start - {REACH})),
n AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, list_position([{ranks}], kind)) AS spans,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, list_position([{ranks}], kind)) FILTER (strong) AS base FROM l GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN n USING (r)
"""
