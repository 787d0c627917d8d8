"""Personal data by bootstrapped contextual extraction.  DataFrame functions only.

Base entities (email, ip, card, phone) come from fixed patterns and checks.
They seed the bootstrap: the words around an entity are lexical patterns (two
words before; one before and one after), the entities and other
identifier-shaped tokens in such surroundings are instances.  On the bipartite
graph of patterns and instances two scores are iterated per kind:

* pattern: the confidence of its distinct instances over their number plus one,
  given at least ``MIN_SUPPORT`` confident instances;
* instance: one for seeds, else the noisy-or of its patterns.

Tokens in a pattern that scores ``ACCEPT`` or more, with as much confidence
themselves, are new spans of that kind; tokens that overlap a base span never
are.  One more scan then reads what else stands in the slots of accepted
patterns, whatever characters it holds (``slots``).  Pattern and instance statistics cover all documents; every step is a
pre-aggregated group or an equi-join whose sides come from written tables.

Offsets: ``split`` gives the gaps between the matches that
``regexp_extract_all`` gives; running sums of their lengths are the spans, in
code points.  The patterns are written so that no text makes them scan more
than linearly.

* Null and empty texts have no spans.  Repeated rows get equal results.
* Equal scores of kinds go to the kind listed first.
* An empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import Scratch, checked_broadcast, row_keys

KINDS = ("email", "ip", "card", "phone")
#: The base patterns.  Possessive quantifiers don't change what matches: what follows a repeated class never
#: begins with it.  An email can only start where its run of local characters starts or the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Identifier-shaped: a run without white space that holds a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
TOKEN_KIND = len(KINDS)
#: Context read on either side (a run of white space counts as one character), rounds, and what accepts a pattern.
TAIL, HEAD, ROUNDS, MIN_SUPPORT, ACCEPT = 48, 32, 3, 3, 0.7
#: Piece lengths added up at a time, buckets of words that may stand before a slot, and words in a piece.
CHUNK, BUCKETS, PIECE = 256, 1 << 16, 64


def _occurs(kind: str, text: Column) -> Column:
    """A cheap necessary condition of a match."""
    return {"email": text.contains("@"), "phone": text.contains("+")}.get(kind, text.rlike("[0-9]" if kind != "token" else "[0-9@]"))


def matches(keyed: DataFrame) -> DataFrame:
    """(_k, kind, value, start, end, tail, head) of every match of every
    pattern and of tokens, unchecked.  ``tail`` and ``head`` are the text before
    and behind the match, whatever other matches lie in it.  One scan;
    documents' texts stay in it."""
    pats = [*PATTERNS.items(), ("token", TOKEN)]
    none = F.array().cast("array<string>")
    text = F.col("_text")
    # A text without a digit and an at sign has no match.  Later filters on the arrays would be pushed below them
    # and find every match a second time: rows without any are dropped by ``explode_outer`` and its null rows.
    keyed = keyed.where(reduce(lambda a, b: a | b, [text.contains(c) for c in "@0123456789"]))
    found = keyed.select("_k", "_text", *[
        F.when(_occurs(k, text), F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"_m{i}") for i, (k, p) in enumerate(pats)])
    cut = found.select("_k", *[f"_m{i}" for i in range(len(pats))], *[
        F.when(F.size(f"_m{i}") > 0, F.split(text, p, -1)).otherwise(none).alias(f"_g{i}") for i, (_, p) in enumerate(pats)])
    # Ends and starts of gaps and matches, as far as a context reaches.
    # A gap may be nearly the whole text: only its end is read, unless white space runs on there.
    flat = lambda x: F.regexp_replace(x, r"\s+", " ")
    joined = lambda a, b: F.concat(a, b)

    def edge(y: Column, side, size: int) -> Column:
        near = side(y, F.lit(2 * size))
        return side(F.when(near.rlike(r"\s\s"), flat(y)).otherwise(flat(near)), F.lit(size))

    cut = cut.select("*", *[
        F.transform(f"_{x}{i}", lambda y: edge(y, side, size)).alias(f"_{x}{name}{i}")
        for i in range(len(pats)) for x in "mg" for name, side, size in (("tail", F.right, TAIL), ("head", F.left, HEAD))])

    def beside(i: int, j: Column) -> tuple[Column, Column]:
        """Text before and behind match ``j``.  A match and the gap at its side
        have two characters or more, so that many pairs fill the context."""
        last, gap = F.least(j, F.lit(TAIL // 2)), F.lit(HEAD // 2)
        before = F.zip_with(F.slice(f"_gtail{i}", j - last + 1, last), F.slice(f"_mtail{i}", j - last + 1, last), joined)
        behind = F.zip_with(F.slice(f"_mhead{i}", j + 2, gap), F.slice(f"_ghead{i}", j + 3, gap), joined)
        return (F.right(F.concat(F.array_join(before, ""), F.get(f"_gtail{i}", j)), F.lit(TAIL)),
                F.left(F.concat(F.get(f"_ghead{i}", j + 1), F.array_join(behind, "")), F.lit(HEAD)))

    def parts(i: int) -> Column:
        m, g = F.col(f"_m{i}"), F.col(f"_g{i}")
        one = lambda j: F.struct(F.lit(i).alias("kind"), j.alias("at"), F.get(m, j).alias("value"),
                                 F.char_length(F.get(g, j)).alias("gap"), *[
                                     x.alias(name) for name, x in zip(("tail", "head"), beside(i, j))])
        empty = F.array().cast("array<struct<kind: int, at: int, value: string, gap: int, tail: string, head: string>>")
        return F.when(F.size(m) > 0, F.transform(F.sequence(F.lit(0), F.size(m) - 1), one)).otherwise(empty)

    rows = cut.select("_k", F.explode_outer(F.concat(*[parts(i) for i in range(len(pats))])).alias("x")).where("x is not null").select("_k", "x.*")
    # Running lengths within one document and pattern.
    upto = Window.partitionBy("_k", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap").cast("long") + F.char_length("value")).over(upto)
    return (rows.withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
            .select("_k", "kind", "value", "start", "end", "tail", "head"))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(acc: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    n = F.char_length(digits)
    return (F.when(kind == KINDS.index("email"), F.lit(True))
            .when(kind == KINDS.index("ip"), value.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .when(kind == KINDS.index("card"), F.when(n.between(16, 19), luhn(digits)).otherwise(F.lit(False)))
            .when(kind == KINDS.index("phone"), n.between(8, 15))
            .otherwise(F.lit(True)))


def spans(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """Checked base spans and identifier-shaped tokens apart from them
    (kind ``TOKEN_KIND``), with their surroundings; written down."""
    rows = matches(keyed)
    token = F.col("kind") == TOKEN_KIND
    # Tokens lose punctuation at their ends, which goes to their context as it does for base spans.
    lead = F.regexp_extract("value", r"^[^\p{L}0-9+@]*+", 0)
    core = F.regexp_replace(F.col("value"), r"^[^\p{L}0-9+@]++|(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")
    trail = F.substr("value", F.char_length(lead) + F.char_length(core) + 1)
    rows = (rows.withColumn("tail", F.when(token, F.right(F.concat("tail", lead), F.lit(TAIL))).otherwise(F.col("tail")))
            .withColumn("head", F.when(token, F.left(F.concat(trail, "head"), F.lit(HEAD))).otherwise(F.col("head")))
            .withColumn("start", F.when(token, F.col("start") + F.char_length(lead)).otherwise(F.col("start")))
            .withColumn("value", F.when(token, core).otherwise(F.col("value")))
            .withColumn("end", F.when(token, F.col("start") + F.char_length("value")).otherwise(F.col("end"))))
    rows = rows.where(valid(F.col("kind"), F.col("value")))
    return scratch.cut(apart(rows.where(F.col("value") != "")), "spans")


def apart(rows: DataFrame) -> DataFrame:
    """Base spans, and the other rows that overlap none: base spans before and
    after, in start order, show that."""
    order = Window.partitionBy("_k").orderBy("start", "kind")
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") < TOKEN_KIND
    rows = (rows.withColumn("b", F.coalesce(F.max(F.when(base, F.col("end"))).over(upto), F.lit(0)))
            .withColumn("a", F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.lit(2**62))))
    free = (F.col("b") <= F.col("start")) & (F.col("a") >= F.col("end"))
    return rows.where(base | free).drop("a", "b")


def surroundings(rows: DataFrame) -> DataFrame:
    """One row per occurrence and lexical pattern: (…, instance, pattern)."""
    words = F.split(F.trim(F.regexp_replace(F.lower("tail"), r"\s+", " ")), " ")
    last, prior = F.element_at(words, -1), F.try_element_at(words, F.lit(-2))
    follow = F.regexp_extract(F.lower("head"), r"^\s*+(\S++)", 1)
    two = F.when(prior.isNotNull() & (prior != "") & (last != ""), F.concat(F.lit("2:"), prior, F.lit(" "), last))
    around = F.when((last != "") & (follow != ""), F.concat(F.lit("1:"), last, F.lit(" _ "), follow))
    return (rows.withColumn("instance", F.lower("value"))
            .withColumn("pattern", F.explode(F.array_compact(F.array(two, around)))))


def _sums(lengths: Column) -> Column:
    """Running sums of an array, by chunks: appending to one long array would copy it each time."""
    run = lambda xs: F.aggregate(xs, F.array().cast("array<bigint>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("bigint")) + x)))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int")),
                         lambda c: run(F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK))))
    before = F.concat(F.array(F.lit(0).cast("bigint")), run(F.transform(chunks, lambda c: F.element_at(c, -1))))
    return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.transform(c, lambda x: x + b)))


def slots(keyed: DataFrame, rows: DataFrame, around: DataFrame, accepted: DataFrame, sure: DataFrame, scratch: Scratch) -> DataFrame:
    """(_k, start, end, kind, score): words in the slots of accepted patterns.

    How many words a slot holds is learnt: two words before mark as many as
    most of their confident instances have; a word before and one after mark
    every number that ``MIN_SUPPORT`` seeds of the kind have.  A pattern's score
    for a number of words counts everything that stands there apart from base
    spans, so that words of prose speak against it; ``ACCEPT`` holds again."""
    width = F.size(F.split("instance", r"\s+"))
    known = (around.select("pattern", "instance").distinct().join(sure, "instance")
             .join(accepted.select("pattern", "kind"), ["pattern", "kind"]).withColumn("width", width))
    known = scratch.cut(known.groupBy("pattern", "kind", "width").agg(F.sum("conf").alias("conf"), F.count(F.lit(1)).alias("n")), "known")
    total = known.groupBy("pattern", "kind").agg(F.max_by("width", F.struct("n", F.negative("width"))).alias("most"),
                                                 F.sum("conf").alias("conf"), F.sum("n").alias("n"))
    wide = (rows.where(F.col("kind") < TOKEN_KIND).select("kind", F.lower("value").alias("instance")).distinct()
            .groupBy("kind", width.alias("width")).count().where(F.col("count") >= MIN_SUPPORT)
            .groupBy("kind").agg(F.collect_set("width").alias("wide")))
    two = F.col("pattern").startswith("2:")
    marks = scratch.cut(total.join(F.broadcast(wide), "kind", "left").withColumn("width", F.explode(
        F.when(two, F.array("most")).otherwise(F.coalesce("wide", F.array("most"))))).drop("most", "wide"), "marks")
    widths = sorted(r["width"] for r in marks.select("width").distinct().collect())
    # Nothing accepted: no scan.
    if not widths:
        return marks.select(F.lit(0).cast("long").alias("_k"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"),
                            "kind", F.col("conf").alias("score"))
    marks = marks.withColumn("left", F.when(F.col("pattern").startswith("2:"), F.col("pattern"))
                             .otherwise(F.substring_index("pattern", " _ ", 1)))
    lefts = scratch.cut(marks.select("left").distinct(), "lefts")
    # A word can only begin a slot if its left context ends like a pattern's: the word before, or its own punctuation.
    # Those endings are known by bucket, a set that the number of patterns doesn't bound; the join below decides.
    bucket = lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS).cast("long"))
    ending = F.substring_index(F.expr("substr(left, 3)"), " ", -1)
    known_ends = lefts.select(bucket(ending).alias("b"), (~ending.rlike("[a-z0-9+@]")).alias("bare")).distinct().collect()
    ends = sorted({r["b"] for r in known_ends})
    sign = lambda w: ~F.ascii(w).between(48, 57) & ~F.ascii(w).between(64, 90) & ~F.ascii(w).between(97, 122)
    # Punctuation has neither ASCII letters nor digits: without a bare ending, a word's own ends no left context.
    begins = (lambda follows, w: sign(w) | follows) if any(r["bare"] for r in known_ends) else (lambda follows, w: follows)
    # Texts are cut into pieces of a few words: whatever looks at a word reads its piece alone, so the work is linear
    # in a text.  A piece carries the words that a context needs of its neighbours.
    most = widths[-1] + 1
    piece = rf"\s*+(?:\S++\s*+){{1,{max(PIECE, 2 * most)}}}+"
    # Filters on what is made here, also those that Spark adds below ``explode``, would cut every text a second time.
    cut = keyed.where(F.col("_text").rlike(r"\S")).select("_k", F.regexp_extract_all("_text", F.lit(piece), F.lit(0)).alias("_p"))
    ends_at = _sums(F.transform("_p", lambda x: F.char_length(x).cast("bigint")))
    beside = F.arrays_zip(F.col("_p").alias("p"), ends_at.alias("e"), F.concat(F.array(F.lit("")), F.col("_p")).alias("b"),
                          F.slice("_p", F.lit(2), F.size("_p")).alias("f"))
    cut = cut.select("_k", F.explode_outer(beside).alias("x")).where("x.p is not null")
    behind = F.coalesce(F.regexp_extract("x.f", rf"^(?:\S++\s*+){{1,{most}}}+", 0), F.lit(""))
    # Only where white space runs on does the whole piece before have to be read.
    near, flat = F.right("x.b", F.lit(2 * TAIL)), lambda x: F.regexp_replace(x, r"\s+", " ")
    prior = F.split(F.trim(F.when(near.rlike(r"\s\s"), F.right(flat("x.b"), F.lit(2 * TAIL))).otherwise(flat(near))), " ")
    cut = cut.select("_k", (F.col("x.e") - F.char_length("x.p")).alias("_o"), F.col("x.p").alias("_p"), behind.alias("_n"), prior.alias("_c"))
    of = lambda x: F.regexp_extract_all(x, F.lit(r"\S++"), F.lit(0))
    cut = cut.select("_k", "_o", F.concat("_p", "_n").alias("_t"), of("_p").alias("_w"), of("_n").alias("_n"),
                     F.array(F.coalesce(F.try_element_at("_c", F.lit(-2)), F.lit("")), F.element_at("_c", -1)).alias("_c"))
    cut = cut.select("_k", "_o", "_t", F.size("_w").alias("_s"), F.concat("_w", "_n").alias("_w"), F.concat("_c", "_w").alias("_c"))
    # Of most words nothing is kept: places are chosen before rows are made, each with the few words its slots may hold.
    cut = cut.withColumn("_f", F.transform("_c", lambda x: bucket(F.lower(F.substr(x, F.lit(1 - TAIL), F.lit(TAIL - 1)))).isin(ends)))
    places = F.filter(F.sequence(F.lit(0), F.col("_s") - 1), lambda j: begins(F.get("_f", j + 1), F.get("_w", j)))
    words = cut.select("_k", "_o", "_t", F.explode_outer(F.transform(places, lambda j: F.struct(
        j.alias("j"), F.get("_c", j).alias("b"), F.get("_c", j + 1).alias("a"), F.slice("_w", j + 1, F.lit(most)).alias("w")))).alias("x"))
    words = words.where("x is not null").select("_k", "_o", "_t", "x.*")
    first = F.get("w", F.lit(0))
    lead = F.when(first.rlike(r"[\p{L}0-9+@]"), F.regexp_extract(first, r"^[^\p{L}0-9+@]*+", 0)).otherwise("")
    words = words.withColumn("lead", F.when(sign(first), lead).otherwise(""))
    # The words that ``surroundings`` sees in a tail and a head.
    tail = F.trim(F.right(F.concat("b", F.lit(" "), "a", F.lit(" "), "lead"), F.lit(TAIL)))
    words = words.withColumn("tail", F.lower(tail))
    last, pair = F.substring_index("tail", " ", -1), F.substring_index("tail", " ", -2)
    words = words.withColumn("left", F.explode(F.array_compact(F.array(
        F.when(pair.contains(" "), F.concat(F.lit("2:"), pair)), F.when(last != "", F.concat(F.lit("1:"), last))))))
    hits = words.join(checked_broadcast(lefts), "left").select("_k", "_o", "_t", "j", "lead", "left", "w")
    hits = hits.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    end_word = F.get("w", F.col("width") - 1)
    hits = hits.where(end_word != "")
    hits = hits.withColumn("trail", F.regexp_extract(end_word, r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", 0))
    follow = F.lower(F.when(F.col("trail") != "", F.left("trail", F.lit(HEAD))).otherwise(F.left(F.get("w", F.col("width")), F.lit(HEAD - 1))))
    hits = hits.withColumn("pattern", F.when(F.col("left").startswith("2:"), F.col("left")).otherwise(F.concat("left", F.lit(" _ "), follow)))
    hits = hits.join(checked_broadcast(marks.select("pattern", "width", F.col("kind").alias("of"), "conf", "n")), ["pattern", "width"])
    # Where the word begins, and what stands from there on.
    front = F.coalesce(F.char_length(F.regexp_substr("_t", F.concat(F.lit(r"^\s*+(?:\S++\s++){"), F.col("j").cast("string"), F.lit("}")))), F.lit(0))
    hits = hits.withColumn("_f", front).withColumn("at", F.col("_o") + F.col("_f")).withColumn("rest", F.substr("_t", F.col("_f") + 1))
    value = F.array_join(F.slice("w", F.lit(1), F.col("width")), " ")
    reach = F.char_length(F.regexp_substr("rest", F.concat(F.lit(r"^\S++(?:\s++\S++){"), (F.col("width") - 1).cast("string"), F.lit("}"))))
    hits = hits.select(
        "_k", "pattern", "width", "of", "conf", "n",
        (F.col("at") + F.char_length("lead")).alias("start"), (F.col("at") + reach - F.char_length("trail")).alias("end"),
        F.lower(F.substr(value, F.char_length("lead") + 1, F.char_length(value) - F.char_length("lead") - F.char_length("trail"))).alias("instance"))
    base = rows.where(F.col("kind") < TOKEN_KIND).select("_k", "start", "end", "kind")
    hits = apart(hits.withColumn("kind", F.lit(TOKEN_KIND)).unionByName(base, allowMissingColumns=True)).where(F.col("kind") == TOKEN_KIND)
    hits = scratch.cut(hits.drop("kind").withColumnRenamed("of", "kind"), "hits")
    new = hits.select("pattern", "kind", "width", "conf", "n", "instance").distinct().join(
        sure.select("instance", "kind", F.lit(1).alias("known")), ["instance", "kind"], "left")
    scored = (new.groupBy("pattern", "kind", "width", "conf", "n").agg(F.sum(F.col("known").isNull().cast("int")).alias("more"))
              .select("pattern", "kind", "width", (F.col("conf") / (F.col("n") + F.col("more") + 1)).alias("score"))
              .where(F.col("score") >= ACCEPT))
    return hits.select("_k", "start", "end", "pattern", "kind", "width").join(scored, ["pattern", "kind", "width"]).select(
        "_k", "start", "end", "kind", "score")


def bootstrap(keyed: DataFrame, rows: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """(_k, kind, start, end): the spans that accepted patterns discover, without those inside another."""
    around = scratch.cut(surroundings(rows), "around")
    edges = scratch.cut(around.select("pattern", "instance").distinct(), "edges")
    size = scratch.cut(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")), "size")
    seeds = scratch.cut(rows.where(F.col("kind") < TOKEN_KIND).select(F.lower("value").alias("instance"), "kind").distinct()
                        .withColumn("conf", F.lit(1.0)), "seeds")
    conf, scored = seeds, None
    for _ in range(rounds):
        total = (edges.join(conf, "instance").groupBy("pattern", "kind")
                 .agg(F.sum("conf").alias("sum"), F.sum((F.col("conf") >= ACCEPT).cast("int")).alias("support"))
                 .where(F.col("support") >= MIN_SUPPORT))
        scored = scratch.cut(total.join(size, "pattern").select("pattern", "kind", (F.col("sum") / (F.col("n") + 1)).alias("score")), "scored")
        miss = F.sum(F.log(1 - F.least("score", F.lit(0.999999))))
        heard = (edges.join(scored.where(F.col("score") >= ACCEPT / 2), "pattern").groupBy("instance", "kind")
                 .agg((1 - F.exp(miss)).alias("heard")))
        known = seeds.select("instance").distinct()
        conf = scratch.cut(seeds.unionByName(heard.join(known, "instance", "left_anti")
                                             .select("instance", "kind", F.col("heard").alias("conf"))), "conf")
    accepted = scratch.cut(scored.where(F.col("score") >= ACCEPT), "accepted")
    sure = scratch.cut(conf.where(F.col("conf") >= ACCEPT), "sure")
    tokens = (around.where(F.col("kind") == TOKEN_KIND).drop("kind").join(accepted, "pattern")
              .join(sure, ["instance", "kind"]).select("_k", "start", "end", "kind", F.col("conf").alias("score")))
    found = (tokens.unionByName(slots(keyed, rows, around, accepted, sure, scratch)).groupBy("_k", "start", "end")
             .agg(F.min_by("kind", F.struct(F.negative("score"), "kind")).alias("kind")))
    # In this order, a span that lies inside another comes after it.
    upto = Window.partitionBy("_k").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("b", F.coalesce(F.max("end").over(upto), F.lit(0))).where(F.col("end") > F.col("b"))
    return found.select("_k", "kind", "start", "end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_email, n_ip, n_card, n_phone (base spans),
    base and found (arrays of (kind, start, end) in order; found holds all)."""
    scratch = Scratch(docs.sparkSession, "pii")
    keyed = row_keys(docs, id_col, text_col, scratch)
    rows = spans(keyed, scratch)
    base = rows.where(F.col("kind") < TOKEN_KIND).select("_k", "kind", "start", "end").withColumn("added", F.lit(False))
    more = bootstrap(keyed, rows, scratch).withColumn("added", F.lit(True))
    item = F.struct("kind", "start", "end")
    per_doc = base.unionByName(more).groupBy("_k").agg(
        *[F.sum((~F.col("added") & (F.col("kind") == i)).cast("long")).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.array_sort(F.collect_list(F.when(~F.col("added"), item))).alias("base"),
        F.array_sort(F.collect_list(item)).alias("found"))
    out = keyed.select("_k", "_id").join(scratch.cut(per_doc, "per-doc"), "_k", "left")
    none = F.array().cast("array<struct<kind: int, start: bigint, end: bigint>>")
    return out.select(F.col("_id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS],
                      F.coalesce("base", none).alias("base"), F.coalesce("found", none).alias("found"))


def as_text(items: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"),
                                                                 x["end"].cast("string"))), ",")
