"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Fixed patterns find the seed entities. What stands around an entity induces lexical patterns: the two words before it; the
word before it and its shape; its shape and the word after it; the words on both sides. Patterns and the instances they
hold, seeds and other tokens with a digit, form a bipartite graph. A pattern's score is the sum of its instances' scores
over their number plus SMOOTHING. Seeds hold 1; another instance's score is the sum of its patterns' scores over half the
number of its patterns, 1 at most: two of the four patterns of a place have to speak for it, and a token that stands in
many places needs as many that do. Scores pass to and fro for some rounds; then instances with a high score are
identifiers that no fixed pattern knows, where a high-scoring pattern holds them.

Spark's regex functions return matches without their places; these follow from the lengths of what split() leaves
between them. Loops over groups, for which Java's matcher recurses, are avoided by marking separators first, one
private character for one, so texts of any length are safe.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import dropped, stored, table

KINDS = ("email", "ip", "card", "phone")
#: A pattern stands before so many different seeds at least.
MIN_SEEDS = 3
ROUNDS = 8
CONFIDENCE = 0.65
SMOOTHING = 0.5
#: A context is what stands in so many characters before and after an entity.
REACH = 80
#: The least length of an identifier.
LEAST = 6
#: Patterns sent to all executors at most; more are joined.
BROADCAST_ROWS = 100_000
#: Values added up at once in running sums.
STRIDE = 128

_CARD_MARK, _OTHER, _DOT = "\uE000", "\uE001", "\uE002"
_LOCAL = f"A-Za-z0-9._%+{_DOT}-"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++{_DOT}[A-Za-z0-9{_DOT}-]*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Runs of digits and marked separators; shorter ones can't hold 12 digits.
_CARD = f"[0-9][0-9{_CARD_MARK}]{{11,}}+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SPACE = r"\x20\x09-\x0D"
#: A run without white space that holds a digit.
_TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+"

_MATCHES = "array<struct<a:int,z:int,s:string,tail:string,head:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _running(lengths: Column) -> Column:
    """Running sums of an array: over STRIDE values each, then over those sums, so a long array costs its length times STRIDE."""
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, v: acc + v)
    stride = F.lit(STRIDE)

    def body(own: Column) -> Column:
        n = F.size(own)
        sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / stride).cast("int")), lambda j: total(F.slice(own, j * stride + 1, stride)))
        heads = F.aggregate(sums, F.array(F.lit(0)), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))
        place = lambda i: F.floor(i / stride).cast("int")
        return _let(heads, lambda h: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(h, place(i)) + total(F.slice(own, place(i) * stride + 1, i % stride + 1))))

    return F.when(F.size(lengths) > 0, _let(lengths, body)).otherwise(F.array().cast("array<int>"))


def matches(text: Column, pattern: str) -> Column:
    """Each match: start and end (exclusive) in code points, the match, and what stands in REACH characters before (back to the match before) and after it."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def body(gaps: Column) -> Column:
        pairs = F.filter(F.zip_with(gaps, found, lambda g, s: F.struct(F.length(g).alias("n"), F.right(g, F.lit(REACH)).alias("tail"), s.alias("s"))), lambda x: x["s"].isNotNull())
        heads = F.transform(F.slice(gaps, 2, F.greatest(F.size(gaps) - 1, F.lit(0))), lambda g: F.left(g, F.lit(REACH)))
        return _let(F.zip_with(pairs, heads, lambda x, h: x.withField("head", h)), placed)

    def placed(p: Column) -> Column:
        ends = _running(F.transform(p, lambda x: x["n"] + F.length(x["s"])))
        return F.zip_with(p, ends, lambda x, z: F.struct((z - F.length(x["s"])).alias("a"), z.alias("z"), x["s"].alias("s"), x["tail"].alias("tail"), x["head"].alias("head")))

    return _let(gaps, body)


def _none() -> Column:
    return F.array().cast(_MATCHES)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Of 1 to 19 digits: every second from the right doubled, less 9 beyond 9, the sum divisible by 10."""
    one = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.substring(one, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def shape(s: Column) -> Column:
    """Digits as 0, runs of small and large letters as a and A."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), r"\p{Lu}+", "A"), r"(?:(?!A)\p{L})+", "a")


def contexts(tail: Column, s: Column, head: Column) -> Column:
    """The lexical patterns of an entity between two texts. What touches it is no word, nor is one with a digit or without a letter; a pattern that lacks a word doesn't exist."""
    def words(text: Column) -> Column:
        return F.transform(F.filter(F.split(F.lower(text), f"[{_SPACE}]+"), lambda w: w != ""), lambda w: F.when(w.rlike(r"\p{L}") & ~w.rlike("[0-9]"), w))

    before, after = words(F.regexp_replace(tail, f"[^{_SPACE}]+$", "")), words(F.regexp_replace(head, f"^[^{_SPACE}]+", ""))
    last, other, first, form = F.try_element_at(before, F.lit(-1)), F.try_element_at(before, F.lit(-2)), F.get(after, F.lit(0)), shape(s)
    join = lambda kind, *parts: F.concat(F.lit(kind), *[x for p in parts for x in (F.lit(" "), p)])
    return F.array_compact(F.array(join("ll", other, last), join("ls", last, form), join("sr", form, first), join("lr", last, first)))


def base_spans(text: Column) -> Column:
    """Sorted spans (a, kind by number, z, s: the match, a card's digits alone, p: its patterns) of the four fixed kinds; each is tried only on texts that could hold it."""
    has = F.contains
    dotted = F.regexp_replace(F.regexp_replace(text, f"[{_CARD_MARK}{_DOT}]", _OTHER), r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    email = F.when(has(text, F.lit("@")), matches(dotted, _EMAIL)).otherwise(_none())
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(matches(text, _IP), lambda x: F.forall(F.split(x["s"], r"\."), part))).otherwise(_none())
    marked = F.regexp_replace(F.translate(text, _CARD_MARK, _OTHER), r"(?<=[0-9])[\x20-](?=[0-9])", _CARD_MARK)
    many = lambda s, low, high: F.length(s).between(low, high)
    card = F.filter(matches(marked, _CARD), lambda x: many(_digits(x["s"]), 12, 19) & luhn(F.left(_digits(x["s"]), F.lit(19))))
    card = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), card).otherwise(_none())
    phone = F.when(has(text, F.lit("+")), F.filter(matches(text, _PHONE), lambda x: many(_digits(x["s"]), 9, 15))).otherwise(_none())
    same = lambda k, s: _digits(s) if KINDS[k] == "card" else F.translate(s, _DOT, ".")
    return F.array_sort(F.concat(*[_of_kind(s, k, same) for k, s in enumerate((email, ip, card, phone))]))


def _of_kind(found: Column, k: int, same: Callable[[int, Column], Column]) -> Column:
    return F.transform(found, lambda x: F.struct(x["a"].alias("a"), F.lit(k).alias("k"), x["z"].alias("z"), same(k, x["s"]).alias("s"), contexts(F.translate(x["tail"], _DOT + _CARD_MARK, ". "), F.translate(x["s"], _DOT + _CARD_MARK, ". "), F.translate(x["head"], _DOT + _CARD_MARK, ". ")).alias("p")))


def tokens(text: Column) -> Column:
    """Tokens with a digit: place, text without the punctuation around it, and its patterns."""

    def one(x: Column) -> Column:
        core = F.regexp_replace(x["s"], r"^[^\p{L}\p{N}@+#]+", "")
        a = x["z"] - F.length(core)
        core = F.regexp_replace(core, r"[^\p{L}\p{N}]+$", "")
        return F.struct(a.alias("a"), (a + F.length(core)).alias("z"), core.alias("s"), contexts(x["tail"], core, x["head"]).alias("p"))

    found = F.filter(F.transform(matches(text, _TOKEN), one), lambda x: F.length(x["s"]) > 0)
    return F.when(text.rlike("[0-9]"), found).otherwise(F.array().cast("array<struct<a:int,z:int,s:string,p:array<string>>>"))


def _sent(patterns: DataFrame) -> DataFrame:
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_ROWS else patterns


def score(edges: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """edges (p, s, seed), once each, and the patterns (p) to follow -> their scores (p, score), and those of instances (s, score) that aren't seeds. Each round is a written table, so the plan stays short."""
    known = edges.groupBy("s").agg(F.max("seed").alias("seed"), F.greatest(F.lit(1.0), F.count(F.lit(1)) / 2).alias("places"))
    followed = stored(edges.select("p", "s").join(_sent(patterns), "p", "left_semi").join(known, "s"), "pii-followed")
    scores = stored(followed.groupBy("p").agg((F.sum(F.col("seed").cast("double")) / (F.count(F.lit(1)) + SMOOTHING)).alias("score")), "pii-scores")
    for i in range(rounds):
        told = followed.where("not seed").join(scores, "p").groupBy("s").agg(F.least(F.lit(1.0), F.sum("score") / F.first("places")).alias("score"))
        told = stored(told, "pii-instances")
        if i + 1 < rounds:
            again = followed.join(told, "s", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
            again = stored(again.groupBy("p").agg((F.sum("score") / (F.count(F.lit(1)) + SMOOTHING)).alias("score")), "pii-scores")
            dropped(scores)
            dropped(told)
            scores = again
    return scores, told


def extract(documents: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context.

    A null text counts as empty: no spans, the digest of nothing. Offsets are code points. Whole base matches
    are the seeds of the graph, and tokens with a digit that touch none of them its other instances; both count once for
    a pattern however often they stand there, so copies of a document change no score. Rows are independent but for the
    patterns learned from all of them; repeated rows give repeated rows, an empty table none. Every pattern with
    min_seeds different seeds is followed, however large the corpus, and none is cut. Texts may be of any length; one
    with m base matches and n tokens costs m times n comparisons.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select("doc_id", base_spans(text).alias("base"), tokens(text).alias("tokens"))
    touches = lambda base, t: F.exists(base, lambda b: (b["a"] < t["z"]) & (t["a"] < b["z"]))
    free = F.filter("tokens", lambda t: ~touches(F.col("base"), t) & (F.size(t["p"]) > 0))
    earlier = lambda x, y: (x["a"] < y["z"]) & (y["a"] < x["z"]) & ((x["a"] < y["a"]) | ((x["a"] == y["a"]) & (x["k"] < y["k"])))
    first = F.filter("base", lambda x: ~F.exists("base", lambda y: earlier(y, x)))
    seeds = F.transform(first, lambda x: F.struct(x["p"].alias("p"), x["s"].alias("s")))
    spans = F.transform("base", lambda x: F.struct(x["a"].alias("a"), x["k"].alias("k"), x["z"].alias("z")))
    rows = stored(rows.select("doc_id", spans.alias("base"), free.alias("tokens"), seeds.alias("seeds"), F.monotonically_increasing_id().alias("row")), "pii-spans")
    held = lambda column, seed: F.flatten(F.transform(column, lambda t: F.transform(t["p"], lambda p: F.struct(p.alias("p"), t["s"].alias("s"), F.lit(seed).alias("seed")))))
    edges = rows.select(F.explode(F.concat(held("seeds", True), held("tokens", False))).alias("t")).select("t.*").groupBy("p", "s").agg(F.max("seed").alias("seed"))
    edges = stored(edges, "pii-graph")
    patterns = stored(edges.where("seed").groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds).select("p"), "pii-patterns")
    scores, told = score(edges, patterns)
    high = scores.where(F.col("score") >= confidence).select("p")
    found = told.where(F.col("score") >= confidence).select("s")
    fresh = F.filter("tokens", lambda t: F.length(t["s"]) >= LEAST)
    hits = rows.select("row", F.explode(fresh).alias("t")).select("row", "t.s", F.explode("t.p").alias("p"), F.struct(F.col("t.a").alias("a"), F.lit(len(KINDS)).alias("k"), F.col("t.z").alias("z")).alias("hit"))
    hits = hits.join(_sent(found), "s", "left_semi").join(_sent(high), "p", "left_semi").groupBy("row").agg(F.collect_set("hit").alias("hits"))  # a row's own tokens
    rows = rows.join(hits, "row", "left")
    more = F.coalesce("hits", F.array().cast("array<struct<a:int,k:int,z:int>>"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    named = lambda s: F.concat_ws(",", F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["a"].cast("string"), x["z"].cast("string"))))
    count = lambda i: F.size(F.filter("base", lambda x: x["k"] == i)).cast("long")
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)], F.sha2(named(F.col("base")), 256).alias("base_sha256"),
        named(F.array_sort(F.concat("base", more))).alias("spans"), F.size(more).cast("long").alias("n_context"),
    )


def op10_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "documents"))
