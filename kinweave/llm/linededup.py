"""Operator 5, line dedup: a log-template tree of fixed depth over the lines of all documents.

Lines are cut into tokens; a token with a digit is a variable field from the
start (``<*>``), unless less than ``similarity`` of the line would be left. The tree's levels are the token count and the leading
``depth`` tokens; a leaf generalises further: a position whose most frequent
token covers less than ``constant`` of the leaf's lines becomes variable, and
if enough positions stay constant (``similarity``) the lines that fit them
share one template. The lines that don't fit are a group of their own, to which
the same applies; a group without a template is split by the tokens of its
variable position with the most frequent token, down to ``LEAF_LEVELS`` more
levels: the depth of the tree is fixed. A template recurs if it is met in ``min_docs`` or more
documents that are not copies of each other; recurring templates are dropped
everywhere. Templates of ``passage_tokens`` or more tokens that two such
documents share stay in the document of the smallest id only.

Copies don't count: each document has a sketch (the ``SKETCH`` least hashes of
its long words, or of all its words if those are few), and two documents are
copies if their sketches put the similarity of these sets at ``alike`` or more:
documents under one footer are unrelated unless they share over two thirds of their words. A template is met in as
many documents as are found no two of which are copies; how many copies there
are besides, or how large the corpus is, does not matter. Families of copies
are left to document-level dedup.

Every decision is about a template, so it holds for all rows with it, however
often a row is repeated. Null and empty texts pass unchanged; blank lines stay;
null ids count as the largest id, and among equal ids the order is by a hash of the text. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinweave.llm.common import free_name, let, table
from kinweave.scratch import materialize, scope

MIN_DOCS, DEPTH, CONSTANT, SIMILARITY, PASSAGE_TOKENS, ALIKE = 3, 4, 0.7, 0.6, 8, 0.7
#: Levels of the tree below the leading tokens, each a split by the telling position of a group.
LEAF_LEVELS = 6
_LAST = (1 << 63) - 1
FIRST = "struct<key:bigint,row:bigint>"
#: Templates (one number each) that are broadcast at most; 16 MB of them.
BROADCAST_ROWS = 1_000_000
#: Hashes of a document's sketch; documents of a template that are looked at first; documents compared in one group.
SKETCH, FIRST_DOCS, GROUP_DOCS = 64, 16, 64


def _even(text: Column) -> Column:
    """The text with single blanks for other white space but line breaks."""
    odd = text.contains("\t") | text.contains("  ") | text.contains("\r") | text.contains("\x0b") | text.contains("\x0c")
    return F.when(odd, F.regexp_replace(text, r"[ \t\x0b\x0c\r]+", " ")).otherwise(text)


def _plain(text: Column) -> Column:
    """Whether a text is even as it is and has no digits; a class of single characters is looked up faster than ranges."""
    return ~text.rlike(r"[\t\x0b\x0c\r0123456789]") & ~text.contains("  ")


def _trimmed(even: Column) -> Column:
    return F.transform(F.split(even, "\n"), lambda x: F.trim(x))


def _tokens(x: Column) -> Column:
    """Tokens of a line; bytes are counted, for blanks have one."""
    return F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) + 1


def _templates(even: Column) -> Column:
    """A line of which too little is left when its fields are masked stays as it is."""
    fields = lambda x: (F.octet_length(x) - F.octet_length(F.replace(x, F.lit("<*>"), F.lit("")))) / 3
    pick = lambda ms: F.transform(F.split(even, "\n"), lambda x, i: F.trim(F.when(fields(F.get(ms, i)) <= (1 - SIMILARITY) * _tokens(F.get(ms, i)), F.get(ms, i)).otherwise(x)))
    masked = F.split(F.regexp_replace(even, r"[^\s0-9]*+[0-9]\S*", "<*>"), "\n")
    return F.when(even.rlike("[0-9]"), let(masked, pick)).otherwise(_trimmed(even))


def templates(text: Column) -> Column:
    """The lines of a text with digit-bearing tokens masked and white space even; blank lines are empty."""
    return F.when(_plain(text), _trimmed(text)).otherwise(let(_even(text), _templates))


def _sketch(even: Column) -> Column:
    """The least hashes of the long words, in order; of all words where long ones are few."""
    flat = F.split(F.replace(even, F.lit("\n"), F.lit(" ")), " ")
    hashed = lambda ws: F.array_distinct(F.transform(ws, lambda w: F.hash(w)))
    long = lambda ws: hashed(F.filter(ws, lambda w: F.length(w) >= 9))
    pick = lambda ws: let(long(ws), lambda hs: F.when(F.size(hs) >= 16, hs).otherwise(hashed(ws)))
    return F.slice(F.sort_array(let(flat, pick)), 1, SKETCH)


def _copies(a: Column, b: Column, alike: float) -> Column:
    """Whether two sketches put the similarity at ``alike`` or more."""
    both = F.array_intersect(a, b)
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    close = let(least, lambda u: F.size(F.array_intersect(u, both)) >= alike * F.size(u))
    return F.when(F.size(both) < alike * F.greatest(F.size(a), F.size(b)), False).otherwise(close)


def _line(x: Column, depth: int) -> Column:
    return let(_tokens(x), lambda n: F.struct(F.xxhash64(x).alias("t"), F.xxhash64(n, F.substring_index(x, " ", depth)).alias("leaf"), n.alias("n")))


def _digest(text: Column, depth: int) -> Column:
    """The sketch of a text; template, leaf and token count of its lines, each but once; the templates of all its lines in order."""
    parts = lambda ts: F.transform(F.array_distinct(F.filter(ts, lambda x: x != "")), lambda x: _line(x, depth))
    all_of = lambda even, lines: let(lines, lambda ts: F.struct(_sketch(even).alias("least"), parts(ts).alias("parts"), F.transform(ts, lambda x: F.xxhash64(x)).alias("ts")))
    return F.when(_plain(text), all_of(text, _trimmed(text))).otherwise(let(_even(text), lambda even: all_of(even, _templates(even))))


def _met(lines: DataFrame, *by: str) -> DataFrame:
    """Sketches of what two or more sketches have; the hot ones are summed twice before they meet."""
    return lines.select(*by, "sketch").distinct().groupBy(*by).agg(F.count("*").alias("families")).where("families > 1")


def _few(keys: DataFrame) -> DataFrame:
    """Rows to join with, broadcast if they are counted to be few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def _leaders(dealt: DataFrame, sketches: DataFrame, by: str, most: int, alike: float) -> DataFrame:
    """``leaders`` of every ``by, salt``: sketches no two of which are copies, ``most`` at most, as found in order."""
    both = dealt.join(sketches, "sketch").groupBy(by, "salt").agg(F.sort_array(F.collect_list(F.struct("sketch", "least"))).alias("all"))
    none = F.array().cast("array<struct<sketch:bigint,least:array<int>>>")
    full = lambda acc, x: (F.size(acc) >= most) | F.exists(acc, lambda y: _copies(y["least"], x["least"], alike))
    found = F.aggregate("all", none, lambda acc, x: F.when(full(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return both.select(by, "salt", F.transform(found, lambda x: x["sketch"]).alias("leaders"))


def _unrelated(lines: DataFrame, sketches: DataFrame, met: DataFrame, by: str, most: int, alike: float) -> DataFrame:
    """``by, unrelated``: documents (``most`` at most) found to have it that are no copies of each other.

    A few documents settle what is in many unrelated ones; of the rest all are
    compared, in groups of which only the leaders meet again.
    """
    rows = materialize(lines.join(_few(met.select(by, "families")), by).select(by, "sketch", "families").distinct(), "shared-lines")
    some = rows.where(F.pmod(F.xxhash64(by, "sketch"), F.col("families")) < FIRST_DOCS).withColumn("salt", F.lit(0))
    seen = materialize(_leaders(some, sketches, by, most, alike), "leaders").select(by, F.size("leaders").alias("unrelated"))
    left = rows.join(_few(seen.where(F.col("unrelated") >= most).select(by)), by, "left_anti")
    size, k = max(GROUP_DOCS, 4 * most), 0
    while True:
        salt = F.pmod(F.xxhash64("sketch", F.lit(k)), F.ceil(F.col("families") / size))
        groups = materialize(_leaders(left.withColumn("salt", salt), sketches, by, most, alike), "leaders")
        n = F.size("leaders")
        seen = seen.unionAll(groups.select(by, n.alias("unrelated")))
        again = groups.groupBy(by).agg(F.count("*").alias("groups"), F.max(n).alias("n"), F.sum(n).alias("families"))
        again = materialize(again.where((F.col("groups") > 1) & (F.col("n") < most)).select(by, "families"), "leaders-again")
        if again.isEmpty():
            return seen.groupBy(by).agg(F.max("unrelated").alias("unrelated"))
        left, k = groups.join(_few(again), by).select(by, F.explode("leaders").alias("sketch"), "families").distinct(), k + 1


def recurring(lines: DataFrame, sketches: DataFrame, min_docs: int, passage_tokens: int, alike: float) -> DataFrame:
    """Templates to drop; ``first`` is the document that may keep a shared passage, null where none may."""
    met = _met(lines, "t", "n").where((F.col("families") >= min_docs) | (F.col("n") >= passage_tokens))
    met = materialize(met, "met")
    out = met.join(_unrelated(lines, sketches, met, "t", max(2, min_docs), alike), "t")
    everywhere = F.col("unrelated") >= min_docs
    out = out.where((F.col("unrelated") >= 2) & (everywhere | (F.col("n") >= passage_tokens)))
    out = materialize(out.select("t", everywhere.alias("everywhere")), "found")
    passages = lines.join(_few(out.where("not everywhere").select("t")), "t").groupBy("t").agg(F.min(F.struct("key", "row")).alias("first"))
    return out.where("everywhere").select("t", F.lit(None).cast(FIRST).alias("first")).unionAll(passages)


def _generalised(docs: DataFrame, lines: DataFrame, sketches: DataFrame, dropped: DataFrame, min_docs: int, constant: float, similarity: float, alike: float) -> DataFrame:
    """``t`` of lines that fit a template generalised in their leaf, where that template recurs."""
    rest = lines.join(dropped.where("first is null").select("t"), "t", "left_anti")
    wide = materialize(_met(rest.where("n > 1"), "leaf").where(F.col("families") >= min_docs), "leaf-met")
    # A template can't be in more unrelated documents than its leaf: the leaves of copies end here.
    most = max(2, min_docs)
    wide = _few(materialize(_unrelated(rest, sketches, wide, "leaf", most, alike).where(F.col("unrelated") >= min_docs).select("leaf"), "wide-leaves"))
    kinds = rest.where("n > 1").join(wide, "leaf").groupBy("t", "leaf", "n").agg(F.count_distinct("sketch").alias("families"), F.min("row").alias("row"))
    kinds = materialize(kinds, "leaf-kinds")
    # Line texts are wide: one document of each template gives its text, and lines are picked before they are shuffled.
    few = F.broadcast if kinds.count() <= BROADCAST_ROWS else lambda keys: keys
    text = docs.join(few(kinds.select("row")), "row", "left_semi").select(F.explode(F.array_distinct(templates(F.col("text")))).alias("line")).where("line <> ''")
    text = text.withColumn("t", F.xxhash64("line")).join(few(kinds.select("t")), "t", "left_semi").groupBy("t").agg(F.first("line").alias("line"))
    kinds = kinds.drop("row")
    own = kinds.join(text, "t").select("t", "n", "families", F.col("leaf").alias("part"), F.split("line", " ").alias("words"))
    shared = None
    for _ in range(LEAF_LEVELS):
        counts = own.select("part", "families", F.posexplode("words").alias("pos", "token")).groupBy("part", "pos", "token").agg(F.count("*").alias("count"), F.sum("families").alias("f"))
        best = counts.groupBy("part", "pos").agg(F.max(F.struct("count", "token")).alias("b"), F.sum("count").alias("all"), F.sum("f").alias("f"))
        share = F.col("b.count") / F.col("all")
        # Held positions with their tokens; the position to split by: a variable one if any, of most frequent token, then the first.
        told = best.groupBy("part").agg(
            F.map_from_entries(F.collect_list(F.when(share >= constant, F.struct("pos", "b.token")))).alias("held"),
            F.max(F.when(share < 1, F.struct((share < constant).alias("variable"), share.alias("share"), (-F.col("pos")).alias("pos")))).alias("split"),
            F.max("all").alias("lines"), F.max("f").alias("f"),
        )
        # Groups end that have one line or can't be met in ``min_docs`` documents.
        told = told.where((F.col("lines") > 1) & (F.col("f") >= min_docs)).drop("lines", "f")
        n, fits = F.size("held"), F.forall(F.map_entries("held"), lambda e: F.get(F.col("words"), e["key"]) == e["value"])
        step = own.join(told, "part").withColumn("fits", (n >= similarity * F.col("n")) & fits).withColumn("lost", F.max("fits").over(Window.partitionBy("part")))
        step = materialize(step.select(*own.columns, "fits", "lost", (-F.col("split.pos")).alias("at")), "leaf-groups")
        if step.isEmpty():
            break
        fit = step.where("fits").select("t", F.col("part").alias("leaf"))
        shared = fit if shared is None else shared.unionAll(fit)
        # A group loses its fitting lines; one that none fits is split; without a position to split by it ends.
        deeper = F.when(F.col("lost"), F.xxhash64("part", F.lit("rest"))).otherwise(F.xxhash64("part", "at", F.get(F.col("words"), F.col("at"))))
        own = step.where("not fits and (lost or at is not null)").select("t", "n", "families", deeper.alias("part"), "words")
    if shared is None:
        return dropped.limit(0)
    shared = materialize(shared, "leaf-fits")
    again = materialize(rest.drop("leaf").join(_few(shared), "t"), "leaf-again")
    met = materialize(_met(again, "leaf").where(F.col("families") >= min_docs), "leaf-met")
    good = _unrelated(again, sketches, met, "leaf", most, alike).where(F.col("unrelated") >= min_docs).select("leaf")
    return shared.join(good, "leaf", "left_semi").select("t", F.lit(None).cast(FIRST).alias("first"))


def drop_recurring_lines(docs: DataFrame, doc_id: str = "doc_id", min_docs: int = MIN_DOCS, depth: int = DEPTH, constant: float = CONSTANT, similarity: float = SIMILARITY, passage_tokens: int = PASSAGE_TOKENS, alike: float = ALIKE) -> DataFrame:
    """``docs`` with recurring lines out of ``text``, and the count of dropped lines as the last column.

    The count's name is ``lines_dropped``; a column of that name is replaced.
    """
    own = [c for c in docs.columns if c != "lines_dropped"]
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST))
    row = F.xxhash64(key, "text")
    slim = docs.where("text <> ''").select(key.alias("key"), row.alias("row"), "text")
    with scope(docs.sparkSession) as keep:
        # The sketch stands below the explode, or it would be computed for every line.
        each = slim.select("key", "row", _digest(F.col("text"), depth).alias("b"))
        each = materialize(each.select("key", "row", F.xxhash64("b.least").alias("sketch"), "b.least", "b.parts", "b.ts"), "lines")
        sketches = materialize(each.groupBy("sketch").agg(F.first("least").alias("least")), "sketches")
        lines = each.select("key", "row", "sketch", F.explode("parts").alias("l")).select("key", "row", "sketch", "l.*")
        exact = materialize(recurring(lines, sketches, min_docs, passage_tokens, alike), "exact-templates")
        wider = _generalised(slim, lines, sketches, exact, min_docs, constant, similarity, alike)
        drops = exact.unionAll(wider).groupBy("t").agg(F.min(F.coalesce("first", F.struct(F.lit(-_LAST - 1).alias("key"), F.lit(0).cast("long").alias("row")))).alias("first"))
        drops = _few(materialize(drops, "templates"))
        name, gone = free_name(docs, "row"), free_name(docs, "gone")
        # Where the lines of each text stand that go, in order.
        places = each.select("key", "row", F.posexplode("ts").alias("at", "t")).join(drops, "t").where(F.struct("key", "row") != F.col("first"))
        hit = places.groupBy("row").agg(F.sort_array(F.collect_set("at")).alias(gone))
        hit = keep(materialize(hit.withColumnRenamed("row", name), "hits"))
    whole = docs.select(*own).withColumn(name, F.when(F.col("text") != "", row))
    # What stays are the runs between lines that go: no line is looked up.
    run = lambda lines, a, j: F.slice(lines, a + 2, F.coalesce(F.get(gone, j), F.size(lines)) - a - 1)
    kept = let(F.split("text", "\n"), lambda lines: F.flatten(F.transform(F.concat(F.array(F.lit(-1)), gone), lambda a, j: run(lines, a, j))))
    cut = F.struct(F.array_join(kept, "\n").alias("text"), F.size(gone).cast("long").alias("n"))
    out = lambda text, n: [*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in own], n.alias("lines_dropped")]
    keys = hit.select(name)
    if keys.count() > BROADCAST_ROWS:
        mended = whole.join(hit, name, "left").withColumn(name, F.when(F.col(gone).isNotNull(), cut))
        return mended.select(*out(F.coalesce(F.col(name)["text"], F.col("text")), F.coalesce(F.col(name)["n"], F.lit(0).cast("long"))))
    # Only texts that lose a line are shuffled.
    keys = F.broadcast(keys)
    kept = whole.join(keys, name, "left_anti").select(*out(F.col("text"), F.lit(0).cast("long")))
    mended = whole.join(keys, name, "left_semi").join(hit.hint("shuffle_hash"), name).withColumn(name, cut)
    return kept.unionAll(mended.select(*out(F.col(name)["text"], F.col(name)["n"])))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
