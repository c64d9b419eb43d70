"""Operator 1: n-gram Jaccard join by vertical partitioning.

The n-grams of the corpus have one global order, rare ones first. The order is cut into fragments; for a candidate
pair the n-grams that both sides have within a fragment are counted fragment by fragment, and the partial overlaps are summed per pair.

1. A sketch of all (document, n-gram) entries says which n-grams may occur in two documents. A document linked to
   another one shares three quarters of its n-grams at least, so documents with fewer possibly shared n-grams are done. A
   second sketch repeats this on what is left.
2. Documents with the same n-gram set are one class, represented by the smallest doc_id.
3. The representatives' n-grams are counted exactly; those in one representative only never match, and documents
   left with less than three quarters of their set are done.
4. Candidate pairs come from the prefixes: two linked sets share one of their first n - ceil(0.75 n) + 1 n-grams in the global
   order (unshared ones, which come first, included). Length and position bounds drop hopeless pairs before they exist.
5. What is asked for are components, so only pairs across components are ever made. First each prefix n-gram links its
   documents to one hub (as many pairs as entries); the pairs are verified and linked documents join. This is repeated
   with other hubs while that finds many links; then come all remaining pairs across components, each document's best partner
   first. A group of thousands of near copies so collapses after pairs in proportion to its size, and no link
   between different components is skipped.

Two sets link when 100 * intersection >= 75 * union. N-grams are compared by 64-bit hashes.

Defined results: a text with fewer than five words is one n-gram, the whole sequence; a null or empty text, or one without
words, has the empty set and links with nothing, its component is its own doc_id; a row with a null doc_id gets its
n_shingles and a null component; equal rows link to themselves only; rows that repeat a doc_id should carry one text.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat, sketch
from voltledger.llm.components import components
from voltledger.llm.shared import saved
from voltledger.llm.spans import let

N = 5
#: Sketches: at least 2**bits cells, doubled for larger corpora until there is a cell for so many bytes of text.
BITS, SECOND_BITS, BYTES_A_CELL = 28, 27, 5
FRAGMENTS = 4
STAR_ROUNDS = 5
BLOCK, SALTS = 256, 4


def _sets(batch: pa.RecordBatch, n: int):
    """(rows, text of each entry, n-gram hash of each entry): distinct entries, by text and hash."""
    for rows, data, offsets in flat.text_slices(batch, limit=1 << 19):
        data = flat.lower(data)
        starts, ends, firsts = flat.words(data, offsets)
        w = flat.Rolling(data)(starts, ends)
        at, h = flat.windows(w, firsts, n)
        doc = np.searchsorted(firsts, at, "right") - 1
        counts = np.diff(firsts)
        short = np.flatnonzero((counts > 0) & (counts < n))
        if len(short):
            whole = flat.mix(flat.Rolling(w, flat._Q)(firsts[short], firsts[short + 1]) + counts[short].astype(np.uint64), 55)
            doc, h = np.concatenate((doc, short)), np.concatenate((h, whole))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        yield rows, doc[new], h[new]


def shingle_sets(docs: DataFrame, n: int = N, bits: int = BITS, second_bits: int = SECOND_BITS) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2 (identity of the set), grams array<long>: n-grams that may be shared, null if too few.

    A second sketch counts only what the first one let through of documents that are still candidates.
    """
    texts = docs.select("doc_id", "text")
    known = texts.where("doc_id is not null and text is not null")
    sc = docs.sparkSession.sparkContext
    seen = sc.broadcast(sketch.repeated(known, lambda b: (h for _, _, h in _sets(b, n)), bits))

    def enough(doc, ok):
        """Entries that pass, of texts of which three quarters pass."""
        total = np.bincount(doc)
        return ok & (100 * np.bincount(doc, weights=ok, minlength=len(total)) >= 75 * total)[doc] if len(doc) else ok

    def passed(batch):
        for _, doc, h in _sets(batch, n):
            yield flat.mix(h[enough(doc, sketch.maybe(seen.value, h, bits))], 4)

    again = sc.broadcast(sketch.repeated(known, passed, second_bits))

    def emit(batches):
        for batch in batches:
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            for rows, doc, h in _sets(batch, n):
                k = rows.stop - rows.start
                size = np.bincount(doc, minlength=k)
                cuts = np.concatenate(([0], np.cumsum(size)))
                # sums of a slice's entries by text, wrapping, also where a text has none
                fp = [np.diff(np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat.mix(h, 31 + i))))[cuts]).view(np.int64) for i in range(2)]
                shared = enough(doc, sketch.maybe(seen.value, h, bits))
                shared[shared] = sketch.maybe(again.value, flat.mix(h[shared], 4), second_bits)
                n_shared = np.bincount(doc, weights=shared, minlength=k)
                use = (size > 0) & (100 * n_shared >= 75 * size) & ~nameless[rows]
                shared &= use[doc]
                at = np.concatenate(([0], np.cumsum(np.where(use, n_shared, 0)))).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(at), pa.array(h[shared].view(np.int64)), mask=pa.array(~use))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, k), pa.array(size.astype(np.int64)), *map(pa.array, fp), grams], ["doc_id", "n_shingles", "fp1", "fp2", "grams"])

    return texts.mapInArrow(emit, "doc_id bigint, n_shingles bigint, fp1 bigint, fp2 bigint, grams array<bigint>")


def _pieces(batch: pa.RecordBatch, limit: int = 1 << 18):
    """The batch in slices of about ``limit`` n-grams (column 2), one row at least, which bounds the temporaries."""
    ends = np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + limit, "right")))
        yield batch.slice(low, high - low)
        low = high


def _shared(reps: DataFrame, bits: int) -> DataFrame:
    """reps without the n-grams that a sketch of the representatives alone calls single, and without sets that lost too many."""
    arrays = lambda b: b.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    parts = lambda b: (flat.mix(arrays(x), 3) for x in _pieces(b))
    seen = reps.sparkSession.sparkContext.broadcast(sketch.repeated(reps, parts, bits))

    def keep(batches):
        for batch in (piece for whole in batches for piece in _pieces(whole)):
            h = arrays(batch)
            ok = sketch.maybe(seen.value, flat.mix(h, 3), bits)
            lists = batch.column(2)
            at = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))))
            left = np.concatenate(([0], np.cumsum(ok)))[at]
            out = pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), pa.array(h[ok].view(np.int64)))
            use = 100 * np.diff(left) >= 75 * batch.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), out], ["id", "n", "grams"]).filter(pa.array(use))

    return reps.mapInArrow(keep, "id bigint, n bigint, grams array<bigint>")


def _ordered(reps: DataFrame) -> DataFrame:
    """id, n, toks array<struct<df, h>>: the shared n-grams of each representative in the global order."""
    tokens = reps.select("id", F.explode("grams").alias("h"))
    df = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    toks = F.sort_array(F.collect_list(F.struct(F.col("df").cast("int").alias("df"), "h"))).alias("toks")
    return tokens.join(df, "h").groupBy("id").agg(toks).join(reps.select("id", "n"), "id").where("100 * size(toks) >= 75 * n").select("id", "n", "toks")


def _segments(sets: DataFrame, fragments: int) -> DataFrame:
    """id, frag, hs array<long>: each set cut at the pivots of the global order. A pivot is (count, hash) as one number."""
    place = lambda x: x["df"].cast("double") + (x["h"].cast("double") / F.lit(2.0**64) + 0.5)
    sample = sets.select(F.explode("toks").alias("t")).select(place(F.col("t")).alias("p"))
    pivots = sample.agg(F.percentile_approx("p", [i / fragments for i in range(1, fragments)], 1000)).first()[0] or []
    edges = [float("-inf"), *sorted(set(pivots)), float("inf")]
    within = lambda a, b: F.filter("toks", lambda x: (place(x) >= a) & (place(x) < b))
    cuts = [F.struct(F.lit(i).alias("frag"), F.transform(within(a, b), lambda x: x["h"]).alias("hs")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return sets.select("id", F.explode(F.array(*cuts)).alias("s")).select("id", "s.frag", "s.hs").where("size(hs) > 0")


def _verified(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """The pairs (x, nx, cx, y, ny, cy) that link, by components: partial overlaps of the fragments, summed per pair."""
    a = segments.select(F.col("id").alias("x"), "frag", F.col("hs").alias("a"))
    b = segments.select(F.col("id").alias("y"), "frag", F.col("hs").alias("b"))
    pair = ["x", "nx", "cx", "y", "ny", "cy"]
    partial = pairs.join(a.hint("merge"), "x").join(b.hint("merge"), ["y", "frag"]).select(*pair, F.size(F.array_intersect("a", "b")).alias("part"))
    whole = partial.groupBy(*pair).agg(F.sum("part").alias("both"))
    return whole.where("100 * both >= 75 * (nx + ny - both)").select(F.col("cx").alias("x"), F.col("cy").alias("y"))


# Joins with tables that grow with the corpus ask for a sort-merge join, so that the plan is the same at every size.

#: Two sets that meet in a prefix n-gram at places px and py, in different components, and can still link by length and place.
_HOPE = "{cx} <> cy and 4 * least({nx}, ny) >= 3 * greatest({nx}, ny) and 175 * (1 + least({nx} - {px} - 1, ny - py - 1)) >= 75 * ({nx} + ny)"


#: Columns of the postings and their names on a side of a pair, followed by x or y.
_SIDE = (("id", ""), ("n", "n"), ("pos", "p"), ("comp", "c"))


def _side(postings: DataFrame, side: str) -> DataFrame:
    return postings.select(*(F.col(c).alias(a + side) for c, a in (("h", "h"), *_SIDE, ("alone", "a"))))


def _once(pairs: DataFrame) -> DataFrame:
    """Pairs with the smaller side as x, each once."""
    swap = F.col("x") > F.col("y")
    either = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    return pairs.select(*(either(k + "x", k + "y") for k in ("", "n", "c")), *(either(k + "y", k + "x") for k in ("", "n", "c"))).distinct()


def _counted(met: Column) -> Column:
    """array<struct<x, nx, cx, k, most>>: each partner of an array once, how often it is there, and the best bound. Linear after a sort."""
    items = F.sort_array(F.transform(met, lambda e: F.struct(e["x"].alias("x"), (-e["most"]).alias("less"), e["nx"].alias("nx"), e["cx"].alias("cx"))))

    def runs(xs: Column) -> Column:
        at = lambda i: F.element_at(xs, i)
        starts = F.filter(F.sequence(F.lit(1), F.size(xs)), lambda i: (i == 1) | (at(i)["x"] != at(F.greatest(i - 1, F.lit(1)))["x"]))

        def pairs(begin: Column) -> Column:
            end = F.concat(F.slice(begin, F.lit(2), F.size(begin)), F.array(F.size(xs) + 1))
            return F.zip_with(begin, end, lambda a, b: F.struct(at(a)["x"].alias("x"), at(a)["nx"].alias("nx"), at(a)["cx"].alias("cx"), (b - a).alias("k"), (-at(a)["less"]).alias("most")))

        return let(starts, pairs)

    return let(items, runs)


#: A pair whose sets have their first common n-gram early enough, and which share no more than k prefix n-grams and what follows one of the prefixes.
_ENOUGH = "175 * e.most >= 75 * (e.nx + ny) and 175 * (e.k + greatest((3 * e.nx + 3) div 4, (3 * ny + 3) div 4) - 1) >= 75 * (e.nx + ny)"


def _all_pairs(postings: DataFrame) -> DataFrame:
    """All pairs across components that can link (x in the smaller component by name), and in how many prefix n-grams (k) they meet.

    The entries of an n-gram that look for partners travel as arrays, in blocks of about ``BLOCK``
    documents where there are more. Those they look among are dealt by ``SALTS * BLOCK`` documents. A key is an n-gram with a block and a
    deal, so that no n-gram, however common, is one task. The partners of a document are counted in its arrays, by block, before they are rows.
    """
    split = postings.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("all")).where("lo <> hi")
    split = saved(split)
    total = 1 + (split.agg(F.max("all")).first()[0] or 0) // BLOCK
    blocks, deals = F.when(F.col("all") > BLOCK, total).otherwise(1).cast("int"), (1 + F.col("all") / (SALTS * BLOCK)).cast("int")
    split = split.select("h", "lo", "hi", blocks.alias("blocks"), deals.alias("deals"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mixed = saved(postings.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(split.hint("merge"), ["h", "salt"]).drop("salt"))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    entry = F.struct(*(F.col(c).alias(k + "x") for c, k in _SIDE), own(F.lit(total), 1).alias("gx"))
    x = mixed.where("comp < hi").select("h", "deals", F.when(F.col("blocks") > 1, own(F.lit(total), 1)).otherwise(0).alias("block"), entry.alias("e"))
    lists = x.groupBy("h", "block", "deals").agg(F.collect_list("e").alias("xs")).select("h", "block", "xs", every("deals").alias("deal"))
    y = mixed.where("comp > lo").select("h", own(F.col("deals"), 2).alias("deal"), every("blocks").alias("block"), *(F.col(c).alias(k + "y") for c, k in _SIDE))
    met = lists.join(y.hint("merge"), ["h", "block", "deal"])
    can = F.expr("transform(filter(xs, e -> e.cx < cy and 4 * least(e.nx, ny) >= 3 * greatest(e.nx, ny)), e -> struct(e.x as x, e.nx as nx, e.cx as cx, e.gx as gx, least(e.nx - e.px, ny - py) as most))")
    met = met.select("y", "ny", "cy", can.alias("xs")).where("size(xs) > 0")
    if total > 1:
        met = met.select("*", F.explode(F.array_distinct(F.transform("xs", lambda e: e["gx"]))).alias("g")).select("y", "ny", "cy", "g", F.expr("filter(xs, e -> e.gx = g)").alias("xs"))
    else:
        met = met.withColumn("g", F.lit(0))
    per_y = met.groupBy("y", "ny", "cy", "g").agg(_counted(F.flatten(F.collect_list("xs"))).alias("xs"))
    return per_y.select("y", "ny", "cy", F.expr(f"filter(xs, e -> {_ENOUGH})").alias("xs")).select("y", "ny", "cy", F.inline("xs")).drop("most")


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels after the found links between components."""
    up = components(found).select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return saved(labels.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))


def _rest(pairs: DataFrame, segments: DataFrame, labels: DataFrame) -> DataFrame:
    """The labels after all pairs. Each document's best partner goes first, and pairs inside a component drop out, as long as
    that takes away a third of the pairs at least: each such round rewrites the others. Then all that are left are verified."""
    left = pairs.count()
    while left:
        found = _joining(pairs, segments)
        if found is not None:
            labels = _joined(labels, found)
            cx, cy = (labels.select(F.col("node").alias(s), F.col("root").alias("c" + s)) for s in "xy")
            pairs = saved(pairs.drop("cx", "cy").join(cx, "x").join(cy, "y").where("cx <> cy"))
        had, left = left, pairs.count()
        if 3 * left > 2 * had:
            found = saved(_verified(_once(pairs), segments))
            return labels if found.isEmpty() else _joined(labels, found)
    return labels


def _joining(pairs: DataFrame, segments: DataFrame) -> DataFrame | None:
    """The links among the best partners of all documents, none if there is no link."""
    best, rest = [], ("nx", "cx", "ny", "cy")
    for own, other in (("x", "y"), ("y", "x")):
        top = pairs.groupBy(own).agg(F.max(F.struct("k", other, *rest)).alias("p"))
        best.append(top.select(own, f"p.{other}", *(f"p.{c}" for c in rest)).select("x", "nx", "cx", "y", "ny", "cy"))
    found = saved(_verified(_once(best[0].union(best[1])), segments))
    return None if found.isEmpty() else found


def links_by_rounds(sets: DataFrame, fragments: int = FRAGMENTS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """node, root over all representatives.

    The hub of an n-gram is the smallest id, then the document with the smallest share of n-grams of its own (it can link with most others), then a
    random one. Star rounds go on while one finds links for more than a hundredth of the representatives; then come all other pairs.
    """
    segments = saved(_segments(sets, fragments))
    prefix = F.expr("slice(toks, 1, cast(n - ceil(0.75D * n) + 1 - (n - size(toks)) as int))")
    rare = sets.select("id", "n", (F.col("n") - F.size("toks")).alias("alone"), F.posexplode(prefix).alias("i", "t"))
    postings = saved(rare.select("id", "n", "alone", F.col("t.h").alias("h"), (F.col("alone") + F.col("i")).alias("pos"), F.col("id").alias("comp")))
    labels, total = sets.select(F.col("id").alias("node"), F.col("id").alias("root")), sets.count()
    stars = star_rounds
    for r in range(star_rounds + 1):
        last = r == stars
        if last:
            return _rest(saved(_all_pairs(postings)), segments, labels)
        else:
            first = {0: F.lit(0.0), 1: F.col("ax") / F.col("nx")}.get(r, F.xxhash64("x", F.lit(r)).cast("double"))
            order = F.struct(first.alias("o"), "x", "nx", "px", "cx")
            hub = _side(postings, "x").groupBy("hx").agg(F.min(order).alias("hub"), F.min("cx").alias("lo"), F.max("cx").alias("hi")).where("lo <> hi")
            met = hub.select("hx", "hub.x", "hub.nx", "hub.px", "hub.cx").join(_side(postings, "y").hint("merge"), F.expr("hx = hy and " + _HOPE.format(nx="nx", px="px", cx="cx")))
            pairs = saved(_once(met))
        found = saved(_verified(pairs, segments))
        n = found.count()
        if n:
            labels = _joined(labels, found)
        if n <= total // 100:
            stars = r + 1
        if n:
            comp = labels.select(F.col("node").alias("id"), F.col("root").alias("comp"))
            postings = saved(postings.drop("comp").join(comp.hint("merge"), "id"))
    return labels


def near_duplicates(docs: DataFrame, n: int = N, bits: int | None = None, second_bits: int | None = None, fragments: int = FRAGMENTS, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), class_id (smallest doc_id with the same set). ``bits``, ``second_bits``: sizes of the sketches, by the texts where not given."""
    more = sketch.doublings(docs, BITS, BYTES_A_CELL) if bits is None or second_bits is None else 0
    bits, second_bits = BITS + more if bits is None else bits, SECOND_BITS + more if second_bits is None else second_bits
    sets = saved(shingle_sets(docs, n, bits, second_bits))
    same = ["n_shingles", "fp1", "fp2"]
    held = sets.where("grams is not null")
    classes = saved(held.groupBy(*same).agg(F.min("doc_id").alias("id")))
    reps = saved(held.withColumnRenamed("doc_id", "id").join(classes.select("id").hint("merge"), "id", "left_semi").select("id", F.col("n_shingles").alias("n"), "grams").dropDuplicates(["id"]))
    roots = links_by_rounds(saved(_ordered(saved(_shared(reps, second_bits)))), fragments, star_rounds)
    known = classes.join(roots, F.col("id") == F.col("node"), "left").select(*same, F.col("id").alias("class_id"), F.coalesce("root", "id").alias("root"))
    held = sets.where("grams is not null").drop("grams").join(known, same)
    rest = sets.where("grams is null").select("doc_id", *same, F.col("doc_id").alias("class_id"), F.col("doc_id").alias("root"))
    return held.select("doc_id", *same, "class_id", "root").union(rest).select("doc_id", "n_shingles", F.col("root").alias("component_id"), "class_id")
