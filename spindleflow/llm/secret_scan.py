"""Secret scans with built-in functions alone: three exact patterns, and a battery of randomness tests.

The battery looks at every run of 16 or more letters of an encoding. It infers the encoding, tests whether the values
are spread evenly over its alphabet (chi-squared over five ranges), whether they cross the middle as often as chance
has it (runs test) and whether neighbours are unrelated (serial correlation), and joins the three by Fisher's method.
What fails is ordinary text, and teaches how ordinary runs go from letter to letter. The likelihood ratio of chance
against ordinary text bounds, inverted, the probability that an ordinary run looks so random; Benjamini and Hochberg's
rule over these bounds, for each band of lengths by itself, keeps the false discoveries below a given share.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindleflow.llm.common import staged

# What each kind of exact pattern matches. Letters of the first stand in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


PATTERNS = {
    "assign": "(" + "|".join(map(_either, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{16,}",
    "random": "[A-Za-z0-9+/_-]{16,}",
}
KINDS = list(PATTERNS)
LEAST = {"assign": 12, "access": 18, "hex": 16, "random": 16}

# Alphabets from the narrowest on; a run has the first that holds all its letters. Runs of digits are mere numbers.
ENCODINGS = (
    ("decimal", string.digits),
    ("hex", string.digits + "abcdef"),
    ("hex", string.digits + "ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
LETTERS = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_-"
CLASSES = "l" * 26 + "u" * 26 + "d" * 10 + "s" * 4


def hits(text: Column, kind: str) -> Column:
    """Leftmost matches that do not overlap, as structs: kind, number, letters before it since the last match, match."""
    pattern = PATTERNS[kind]
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else found
    return F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("hit"), F.transform(judged, F.length).alias("judged")),
        lambda h, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("number"), h["gap"].alias("gap"), h["hit"].alias("hit"), h["judged"].alias("judged")),
    )


def _tail_of_normal(z: Column) -> Column:
    """Two-sided tail of the normal distribution, by the usual logistic approximation."""
    a = F.least(F.abs(z), F.lit(12.0))
    return F.lit(2.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * a + F.lit(0.07056) * a * a * a))


def with_battery(tokens: DataFrame) -> DataFrame:
    """Adds to each token its encoding, the size of its alphabet and the joint p-value of the three tests."""
    encoding, alphabet = F.lit(None).cast("string"), F.lit(LETTERS)
    for name, letters in reversed(ENCODINGS):
        held = F.length(F.translate("token", letters, "")) == 0
        encoding, alphabet = F.when(held, name).otherwise(encoding), F.when(held, letters).otherwise(alphabet)
    # A run that mixes both kinds of base64 has an alphabet of its own.
    df = tokens.withColumn("encoding", F.coalesce(encoding, F.lit("mixed"))).withColumn("alphabet", alphabet)
    df = df.withColumn("k", F.length("alphabet").cast("double")).withColumn("n", F.length("token").cast("double"))
    df = df.withColumn("v", F.expr("transform(split(token, '', -1), c -> CAST(instr(alphabet, c) - 1 AS DOUBLE))"))
    df = df.withColumn("mean", F.expr("aggregate(v, 0D, (a, x) -> a + x) / n"))
    df = df.withColumn("chi", F.expr("aggregate(transform(sequence(0, 4), b -> size(filter(v, x -> floor(x * 5 / k) = b)) - n / 5), 0D, (a, d) -> a + d * d) / (n / 5)"))
    df = df.withColumn("high", F.expr("CAST(size(filter(v, x -> x * 2 >= k)) AS DOUBLE)"))
    df = df.withColumn("runs", F.expr("CAST(1 + size(filter(sequence(1, CAST(n AS INT) - 1), i -> (v[i] * 2 >= k) <> (v[i - 1] * 2 >= k))) AS DOUBLE)"))
    df = df.withColumn("spread", F.expr("aggregate(v, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    df = df.withColumn("joint", F.expr("aggregate(sequence(1, CAST(n AS INT) - 1), 0D, (a, i) -> a + (v[i] - mean) * (v[i - 1] - mean))"))
    low, high, n = F.col("n") - F.col("high"), F.col("high"), F.col("n")
    middle = 2.0 * low * high / n + 1.0
    variance = (middle - 1.0) * (middle - 2.0) / (n - 1.0)
    # The alphabet's five ranges have four degrees of freedom, for which the tail has a closed form.
    p_even = F.exp(-F.col("chi") / 2) * (1.0 + F.col("chi") / 2)
    p_runs = F.when(variance > 0, _tail_of_normal((F.col("runs") - middle) / F.sqrt(variance))).otherwise(F.lit(1e-6))
    p_serial = F.when(F.col("spread") > 0, _tail_of_normal((F.col("joint") / F.col("spread") + 1.0 / n) * F.sqrt(n))).otherwise(F.lit(1e-6))
    half = -sum((F.log(F.greatest(p, F.lit(1e-12))) for p in (p_even, p_runs, p_serial)), F.lit(0.0))
    joined = F.exp(-half) * (1.0 + half + half * half / 2.0)
    return df.withColumn("p_random", joined).select("token", "encoding", "k", "p_random")


def random_tokens(tokens: DataFrame, alpha: float = 0.01, share: float = 0.01) -> DataFrame:
    """The distinct tokens that pass for random: not rejected at ``alpha``, and kept at false discovery rate ``share``."""
    judged = staged(with_battery(tokens), "battery")
    pairs = F.expr("zip_with(split(left(class, length(class) - 1), '', -1), split(substring(token, 2), '', -1), (c, x) -> concat(c, x))")
    # A run of capitals alone is judged as its small letters: a shouted word is no less a word.
    judged = judged.withColumn("shown", F.col("token")).withColumn("token", F.when(F.col("token").rlike("^[A-Z]+$"), F.lower("token")).otherwise(F.col("token")))
    stepped = judged.withColumn("class", F.translate("token", LETTERS, CLASSES)).withColumn("steps", pairs)
    ordinary = stepped.where(F.col("p_random") < alpha).select(F.explode("steps").alias("step")).groupBy("step").count()
    # At most 4 classes times 66 letters.
    counts = {r["step"]: r["count"] for r in ordinary.collect()}
    totals = {c: sum(v for s, v in counts.items() if s[0] == c) for c in "luds"}
    entries = []
    for c in "luds":
        for letter in LETTERS:
            entries += [F.lit(c + letter), F.log10(F.lit((counts.get(c + letter, 0) + 0.5) / (totals[c] + 0.5 * len(LETTERS))))]
    usual = F.create_map(*entries)
    scored = stepped.withColumn("usual", F.aggregate(F.transform("steps", lambda s: usual[s]), F.lit(0.0), lambda a, x: a + x))
    # log10 of the bound on the chance that ordinary text makes this run; bands of doubling length.
    bound = F.greatest(F.lit(0.0), -(F.size("steps") * F.log10("k")) - F.col("usual"))
    scored = scored.select(F.col("shown").alias("token"), "encoding", "p_random", F.floor(F.log2(F.length("token").cast("double"))).cast("int").alias("band"), F.least(F.floor(bound * 10), F.lit(3000)).cast("int").alias("step"))
    scored = staged(scored, "random-tokens")
    # Benjamini-Hochberg on the histogram of tenths of a decade: at most 3001 steps for each band.
    table = scored.groupBy("band", "step").count()
    above = F.sum("count").over(Window.partitionBy("band").orderBy(F.col("step").desc()))
    everything = F.sum("count").over(Window.partitionBy("band"))
    kept = table.withColumn("above", above).withColumn("all", everything)
    kept = kept.where(F.pow(F.lit(10.0), -F.col("step") / 10.0) <= share * F.col("above") / F.col("all"))
    limits = kept.groupBy("band").agg(F.min("step").alias("least"))
    chosen = scored.join(limits, "band").where((F.col("step") >= F.col("least")) & (F.col("p_random") >= alpha))
    return chosen.where("encoding <> 'decimal'").select("token", "encoding")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """Every row with its spans: id, base and added (arrays of start, kind number, end in code points, end exclusive).

    Equal texts are scanned once they are found; they share their spans, however many rows repeat them. NULL texts count
    as empty and have no span. An added span never overlaps a base one.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    found = F.concat(*[hits(F.col("text"), k) for k in KINDS])
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    rows = staged(rows.select("id", F.md5("text").alias("key"), found.alias("hits")), "hits")
    once = rows.where(F.size("hits") > 0).groupBy("key").agg(F.first("hits").alias("hits"))
    each = once.select("key", F.explode("hits").alias("h")).select("key", "h.*")
    order = Window.partitionBy("key", "kind").orderBy("number")
    end = F.sum(F.col("gap") + F.length("hit")).over(order)
    least = F.element_at(F.array(*[F.lit(LEAST[k]) for k in KINDS]), F.col("kind") + 1)
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit")).where(F.col("judged") >= least)
    placed = staged(placed.select("key", "kind", "start", "end", F.when(F.col("kind") == 3, F.col("hit")).alias("token")), "spans")
    chosen = random_tokens(placed.where("kind = 3").select("token").distinct(), **options)
    added = placed.where("kind = 3").join(chosen, "token").select("key", "start", "kind", "end")
    base = placed.where("kind < 3").select("key", "start", "kind", "end")
    span = F.struct("start", "kind", "end")
    lists = base.unionByName(added).groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"), F.array_sort(F.collect_list(F.when(F.col("kind") == 3, span))).alias("added")
    )
    apart = F.filter("added", lambda a: ~F.exists("base", lambda b: (b["start"] < a["end"]) & (a["start"] < b["end"])))
    lists = lists.select("key", "base", apart.alias("added"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    joined = rows.select("id", "key").join(lists, "key", "left")
    return joined.select(F.col("id").alias(id_column), F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _is_kind(kind: int):
    return lambda s: s["kind"] == kind


def report(docs: DataFrame, **options) -> DataFrame:
    """Counts of each exact kind, the digest of the exact spans and all spans, by start and then kind."""
    found = scan(docs, **options)
    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    everything = F.array_sort(F.concat("base", "added"))
    return found.select(found.columns[0], *count, F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(everything).alias("spans"))


def redacted(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mask; spans that overlap are replaced as one."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    by_text = scan(docs.select(F.md5(text).alias("key"), text.alias("t")), "key", "t", **options)
    spans = F.array_sort(F.concat("base", "added"))
    hit = by_text.where((F.size("base") > 0) | (F.size("added") > 0))
    marked = staged(hit.select("key", spans.alias("spans")).groupBy("key").agg(F.first("spans").alias("spans")), "marked")
    row = docs.select(F.struct("*").alias("row"))
    joined = row.join(marked, F.md5(F.coalesce(F.col(f"row.{text_column}"), F.lit(""))) == marked["key"], "left")
    # Walk the spans in order; keep what lies between the last one's end and the next one's start.
    state = F.aggregate(
        F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("done")),
        lambda a, s: F.when(
            s["start"] >= a["at"],
            F.struct(s["end"].alias("at"), F.concat(a["done"], F.substr(F.col(f"row.{text_column}"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mask)).alias("done")),
        ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["done"].alias("done"))),
    )
    walked = joined.select("row", state.alias("state"))
    masked = F.when(F.length("state.done") > 0, F.concat("state.done", F.substr(F.col(f"row.{text_column}"), (F.col("state.at") + 1).cast("int"))))
    return walked.select("row.*", masked.alias("__masked")).withColumn(text_column, F.coalesce("__masked", F.col(text_column))).select(docs.columns)
