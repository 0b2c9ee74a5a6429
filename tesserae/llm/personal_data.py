"""Personal data by bootstrapped contextual extraction.

Base patterns find emails, IP addresses, card and phone numbers. Seeds are their whole spans, and
tokens that by their shape can only be keys or secrets (MIXED: KEY_CHARS or more letters and digits
that change places KEY_TURNS times or more). What stands around seeds makes lexical patterns of three
sides: a field label before them (a word that ends with `:` or `=`, or such a mark and the word before
it), else the word and the two words to their left; and the word and the two words to their right. Words are
lower-cased, their marks kept and their digits read as 0. Every identifier-like token (LEAST_CHARS or
more characters without a blank, LEAST_DIGITS of them digits, that no base span overlaps) is an
instance. Patterns and instances form a weighted graph: a pattern's confidence is the mean score of
its instances (damped by DAMPING), an instance's score the noisy-or of the best confident pattern of
each side. Instances that a label or both sides support with a score of at least ACCEPT are
identifiers and add spans of kind `ctx`, seeds by shape among them; from the next round on they count
like seeds among the LEAST_SEEDS that a pattern needs. Scores only rise, so rounds go on until
nothing is added and the confidences rise by SETTLED or less in the mean.

Positions come from the pieces between matches: the lengths of pieces and matches, summed, are the
starts. The regular expressions take each run of their first class at once (possessive, and only
from the run's start or the end of the last match), which finds the same matches in time linear in
the text. Texts are read once, where they lie; only spans, patterns and hashes are shuffled, summed
in the map tasks first.

Defined results: a null text counts as empty; a row without data has an empty span list, whose
digest is that of the empty string; repeated rows give repeated results and count as often; equal
texts under one id count as one row where added spans are gathered; texts are read whole; a context
word of over CONTEXT_CHARS characters, or one that doesn't end within twice as many, is no pattern;
scores are compared with `at least`, so ties count; further columns go; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, discard, table

KINDS = ("email", "ip", "card", "phone")
#: Each from a run's first character (or where the last match ended), runs taken whole.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without one of these characters has no match.
NEEDED = {"email": "@", "ip": "0123456789", "card": "0123456789", "phone": "+"}
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
LEAST_CHARS, LEAST_DIGITS = 6, 3
DAMPING, CONFIDENT, LEAST_SEEDS, ACCEPT, SETTLED = 2.0, 0.6, 5, 0.9, 0.001
LABEL, LEFT, RIGHT = "=", "<", ">"  #: how the patterns of each side begin
KEY_CHARS, KEY_TURNS = 20, 4
#: A run of letters and digits with a digit after a letter, or a letter after a digit, KEY_TURNS times.
MIXED = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9]{{{KEY_CHARS}}})(?:[A-Za-z]++[0-9]++|[0-9]++[A-Za-z]++){{{KEY_TURNS // 2}}}"
CONTEXT_CHARS = 64  #: a longer context word is no pattern
LOOK = 2 * CONTEXT_CHARS + 8  #: characters around a span in which its context words must end
_BLOCK = 128
_WORD, _GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"


def bind(value: Column, then) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def prefix_sums(values: Column) -> Column:
    """The sum before each element of an int array: over blocks, then within a block."""

    def whole(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(v) - 1, F.lit(_BLOCK))
        blocks = F.transform(starts, lambda s: _sum(F.slice(v, s + 1, F.lit(_BLOCK))))
        before = bind(blocks, lambda b: F.transform(starts, lambda s, k: _sum(F.slice(b, F.lit(1), k))))
        return bind(before, lambda b: F.transform(v, lambda x, i: F.get(b, F.floor(i / _BLOCK).cast("int")) + _sum(F.slice(v, (i - i % _BLOCK) + 1, i % _BLOCK))))

    return bind(values, whole)


def matches(text: Column, pattern: str, needed: str = "") -> Column:
    """start, end, value, and the text before and after, of each leftmost match without overlaps."""

    def located(found: Column) -> Column:
        def placed(parts: Column) -> Column:
            lengths = F.zip_with(F.slice(parts, F.lit(1), F.size(found)), found, lambda a, b: F.length(a) + F.length(b))
            return bind(
                prefix_sums(lengths),
                lambda before: F.transform(
                    found,
                    lambda x, i: F.struct(
                        (F.get(before, i) + F.length(F.get(parts, i))).alias("start"),
                        (F.get(before, i) + F.length(F.get(parts, i)) + F.length(x)).alias("end"),
                        x.alias("value"),
                        F.right(F.get(parts, i), F.lit(LOOK)).alias("left"),
                        F.substring(F.get(parts, i + 1), 1, LOOK).alias("right"),
                    ),
                ),
            )

        none = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")
        return F.when(F.size(found) > 0, bind(F.split(text, pattern, -1), placed)).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needed:
        found = F.when(text.rlike(f"[{needed}]"), found).otherwise(F.array().cast("array<string>"))
    return bind(found, located)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def weighed(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d < 5, 2 * d).otherwise(2 * d - 9)

    return _sum(F.transform(F.sequence(F.lit(1), F.length(digits)), weighed)) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        bare = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        n = F.length(_digits(value))
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _patterns(left: Column, right: Column) -> Column:
    """Lexical patterns of the texts at both sides, which begin and end at a blank."""

    def pattern(text: Column, expression: str) -> Column:
        words = F.regexp_extract(text, expression, 1)
        fits = (words != "") & ~words.rlike(rf"{_WORD}{{{CONTEXT_CHARS + 1}}}")
        return F.when(fits, F.regexp_replace(F.regexp_replace(ascii_lower(words), rf"{_GAP}+", " "), "[0-9]", "0"))

    before = (rf"{_GAP}({_WORD}+){_GAP}+$", rf"{_GAP}({_WORD}+{_GAP}+{_WORD}+){_GAP}+$")
    after = (rf"^{_GAP}+({_WORD}+){_GAP}", rf"^{_GAP}+({_WORD}+{_GAP}+{_WORD}+){_GAP}")
    label = pattern(left, rf"{_GAP}({_WORD}+[:=]|{_WORD}+{_GAP}+[:=]){_GAP}+$")
    words = lambda text, side, expressions: [F.concat(F.lit(side), pattern(text, x)) for x in expressions]
    return F.array_compact(F.array(F.concat(F.lit(LABEL), label), *(F.when(label.isNull(), x) for x in words(left, LEFT, before)), *words(right, RIGHT, after)))


def _around(m: Column, text: Column) -> Column:
    """Patterns of a match: what is glued to it belongs to neither word beside it, and a word that another match cuts is none."""
    before = F.when(m["start"] == F.length(m["left"]), F.concat(F.lit(" "), m["left"])).otherwise(m["left"])
    after = F.when(m["end"] + F.length(m["right"]) == F.length(text), F.concat(m["right"], F.lit(" "))).otherwise(m["right"])
    return _patterns(F.regexp_replace(before, rf"{_WORD}+$", ""), F.regexp_replace(after, rf"^{_WORD}+", ""))


def base_spans(text: Column) -> Column:
    """start, order of the kind, end and kind of all base matches, sorted; and each one's key and patterns as a seed."""

    def of(k: int, kind: str) -> Column:
        kept = F.filter(matches(text, PATTERNS[kind], NEEDED.get(kind, "")), lambda m: valid(kind, m["value"]))
        told = lambda m: _digits(m["value"]) if kind in ("card", "phone") else ascii_lower(m["value"])
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("k"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.xxhash64(told(m)).alias("key"), _around(m, text).alias("patterns")))

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def candidates(text: Column, base: Column) -> Column:
    """start, end, key (a hash), patterns, seed and span of the base spans and of the identifier-like tokens that no base span overlaps.

    span: it is no base span, and may be added. A token's marks at its ends belong to its span, not to its key.
    """
    told = F.filter(matches(text, TOKEN, NEEDED["ip"]), lambda m: (F.length(m["value"]) >= LEAST_CHARS) & (F.length(_digits(m["value"])) >= LEAST_DIGITS))
    told = F.filter(told, lambda m: ~F.exists(base, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    bare = lambda m: F.regexp_replace(ascii_lower(m["value"]), r"^[^a-z0-9]+|[^a-z0-9]+$", "")
    row = lambda m, key, patterns, seed, span: F.struct(m["start"].alias("start"), m["end"].alias("end"), key.alias("key"), patterns.alias("patterns"), seed.alias("seed"), F.lit(span).alias("span"))
    tokens = F.transform(told, lambda m: row(m, F.xxhash64(bare(m)), _around(m, text), m["value"].rlike(MIXED), True))
    return F.concat(F.transform(base, lambda b: row(b, b["key"], b["patterns"], F.lit(True), False)), tokens)


def discovered(tokens: DataFrame, told: Callable[[int, int], None] | None = None) -> DataFrame:
    """Keys of identifiers, from tokens(key, patterns, seed, span); told is called with the numbers of patterns and identifiers of each round."""
    edges = tokens.select("key", "seed", "span", F.explode("patterns").alias("pattern"))
    edges = cut(edges.groupBy("pattern", "key").agg(F.count(F.lit(1)).alias("times"), F.max("seed").alias("seed"), F.max("span").alias("span")), "pii-edges")
    sides = ("label", "left", "right")
    seeds = edges.where("seed").select("key", F.lit(1.0).alias("score"), F.lit(True).alias("sure")).distinct()
    scores, last, before = seeds, (0, 0, 0.0), []
    while True:
        rated = edges.join(scores, "key", "left").groupBy("pattern")
        confidence = (F.sum(F.col("times") * F.coalesce("score", F.lit(0.0))) / (F.sum("times") + DAMPING)).alias("confidence")
        patterns = rated.agg(confidence, F.count_if(F.coalesce("sure", F.lit(False))).alias("sure"))
        patterns = cut(patterns.where((F.col("confidence") >= CONFIDENT) & (F.col("sure") >= LEAST_SEEDS)).select("pattern", "confidence"), "pii-patterns")
        best = [F.max(F.when(F.startswith("pattern", F.lit(side)), F.col("confidence"))).alias(name) for side, name in zip((LABEL, LEFT, RIGHT), sides, strict=True)]
        supported = edges.where("span").join(patterns, "pattern").groupBy("key").agg(*best)
        doubt = reduce(lambda a, b: a * b, (1 - F.coalesce(c, F.lit(0.0)) for c in sides))
        supported = supported.select("key", (1 - doubt).alias("score"), (F.col("label").isNotNull() | F.col("left").isNotNull() & F.col("right").isNotNull()).alias("enough"))
        supported = cut(supported.select("key", "score", (F.col("enough") & (F.col("score") >= ACCEPT)).alias("sure")), "pii-scores")
        rise = patterns.agg(F.count(F.lit(1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        now = (rise[0], supported.where("sure").count(), rise[1])
        discard(*before)  # of the last round; this one's tables are written
        before = [patterns, supported]
        if told:
            told(*now[:2])
        if now[:2] == last[:2] and now[2] - last[2] <= SETTLED * max(1, now[0]):
            return supported.where("sure").select("key")
        last = now
        scores = seeds.unionByName(supported.select("key", "score", "sure"))
        scores = scores.groupBy("key").agg(F.max("score").alias("score"), F.max("sure").alias("sure"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base (base spans) and added (spans of unseen identifiers) of each row of docs(doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    spans = F.transform("base", lambda b: F.struct(*(b[c].alias(c) for c in ("start", "k", "end", "kind"))))
    read = cut(read.select("doc_id", F.xxhash64("text").alias("mark"), spans.alias("base"), candidates(F.col("text"), F.col("base")).alias("tokens")), "pii-read")
    tokens = read.select("doc_id", "mark", F.explode("tokens").alias("t")).select("doc_id", "mark", "t.*")
    keys = cut(discovered(tokens), "pii-found")
    spans = tokens.where("span").join(keys, "key").groupBy("doc_id", "mark")
    spans = spans.agg(F.collect_set(F.struct("start", F.lit(len(KINDS)).alias("k"), "end", F.lit("ctx").alias("kind"))).alias("added")).alias("s")
    joined = read.alias("r").join(spans, F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.mark") == F.col("s.mark")), "left")
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    return joined.select("r.doc_id", "base", F.coalesce("added", none).alias("added"))


def op5_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    whole = F.sort_array(F.concat("base", "added"))
    n_ctx, n_spans = F.size("added").cast("long").alias("n_ctx"), F.size(whole).cast("long").alias("n_spans")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(whole).alias("spans"), n_ctx, n_spans)
