"""N-gram Jaccard join (operator 4): grouped prefix join of word-shingle sets.

A text's set holds 64-bit hashes of its 5-word shingles.  Two sets link when
``100 * |x & y| >= 80 * |x | y|``.  Under one order of all shingles, linked sets
share a shingle in their prefixes (``n - ceil(0.8 n) + 1`` first shingles).

1. Every text becomes a set; the table of prefixes, set digests and 512-bit
   parity sketches is written once.  Shingles that many texts carry come last
   in the order; which those are only changes how many candidates there are.
2. Equal sets collapse to one node.  Nodes are sorted by the least shingles of
   their hash ranges, in a few rotations; neighbours in a sort are the most
   similar, and each node is verified against the nearest few.  This joins large
   families without pairing all their members.
3. Nodes of one component with the same size and prefix form a group.  Groups
   that share a prefix shingle and belong to different components are filtered
   by size and position, then expanded to members, filtered by sketch (the
   parity sketch bounds the symmetric difference from below) and verified on
   their whole sets.  Pairs inside a component can't change the result.
4. Components of all verified links.

Every candidate that passes the exact filters is verified: no cap on partners,
buckets or groups.  Verification tasks hold one text and at most
``MEMBERS`` partners.  Tables are broadcast only below a counted number of
rows, else joined by shuffle.

Defined cases: null, empty or blank texts have an empty set, linked with
nothing; texts of 1 to 4 words have one shingle; repeated rows are equal sets
and link; rows with null ids are nodes like others and don't give their id to a
component unless it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recspark.llm.common import arrow_rows, components, lean, small, stored

WORDS = 5
NUM, DEN = 80, 100
SKETCH_WORDS = 8
#: hash ranges of a set, sorts by them, following rows compared in a sort, and partners verified
RANGES, SORTS, AHEAD, PARTNERS = 16, 4, 64, 2
MEMBERS = 200
#: shingles counted per chunk, least count in a chunk to be reported, most that are put last
CHUNK, CHUNK_LEAST, HOT = 2_000_000, 3, 100_000
#: most shingles (one long each) that are broadcast
BROADCAST_SHINGLES = 2_000_000

_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
#: bytes of text hashed at a time
PIECE = 1 << 18


def _finish(x: np.ndarray) -> np.ndarray:
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


#: a number for each byte value
_BYTE = _finish(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse."""
    if not _POWERS:
        for base in (_BASE, _INVERSE):
            steps = np.full(PIECE, base, np.uint64)
            steps[0] = 1
            _POWERS.append(np.multiply.accumulate(steps))
    return _POWERS[0], _POWERS[1]


def _power(base: int, n: int) -> np.ndarray:
    return np.array([pow(base, n, 1 << 64)], np.uint64)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of the words of a text: each word's bytes as a polynomial,
    the difference of one running sum, which is taken piece by piece."""
    b = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[b], [True]])))
    power, inverse = _powers()
    run, shift, total = np.zeros(len(edges), np.uint64), np.zeros(len(edges), np.uint64), np.zeros(1, np.uint64)
    for lo in range(0, len(b), PIECE):
        part = b[lo:lo + PIECE]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * power[:len(part)], dtype=np.uint64)]) * _power(_BASE, lo)
        here = slice(*np.searchsorted(edges, (lo, lo + len(part))))
        run[here] = sums[edges[here] - lo] + total
        shift[here] = inverse[edges[here] - lo] * _power(_INVERSE, lo)
        total = total + sums[-1:]
    run[np.searchsorted(edges, len(b)):] = total
    start, end = edges[::2], edges[1::2]
    return _finish((run[1::2] - run[::2]) * shift[::2] + (end - start).astype(np.uint64) * _MULT), start


def _hashed(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` words."""
    out = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ words[i:i + len(out)]) * _MULT
        out ^= out >> np.uint64(29)
    return out


def _distinct(s: np.ndarray) -> np.ndarray:
    s = np.sort(s)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def shingle_sets(texts: list[str | None]):
    """Sorted distinct hashes of the shingles of each text.  ``bytes.lower`` is
    the contract's A-Z.  Texts are hashed together, about ``PIECE`` bytes at a time."""
    group: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        group.append(data)
        size += len(data) + 1
        if size >= PIECE or i + 1 == len(texts):
            words, starts = _words(b"\n".join(group))
            ends = np.cumsum([len(d) + 1 for d in group])
            last = np.searchsorted(starts, ends)
            shingles = _hashed(words, WORDS) if len(words) >= WORDS else words[:0]
            for lo, hi in zip([0, *last[:-1].tolist()], last.tolist()):
                if hi - lo >= WORDS:
                    yield _distinct(shingles[lo:hi - WORDS + 1])
                else:
                    yield _hashed(words[lo:hi], hi - lo) if hi > lo else words[:0]
            group, size = [], 0


def shingle_set(text: str | None) -> np.ndarray:
    return next(shingle_sets([text]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * inter >= NUM * (len(a) + len(b) - inter) and inter > 0


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1 if n else 0


def _ordered(s: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order: other shingles by hash, then the hot ones
    by their rank."""
    if not len(hot) or not len(s):
        return s
    at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
    is_hot = hot[at] == s
    return np.concatenate([s[~is_hot], s[is_hot][np.argsort(rank[at[is_hot]])]]) if is_hot.any() else s


def parity_sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set in at least as many bits as it has members (a power of
    two, 512 at least) as longs.  XOR of its halves is the sketch of half as
    many bits; the bits in which two sketches differ are at most the members in
    which the sets differ."""
    bits = max(64 * SKETCH_WORDS, 1 << (len(s) - 1).bit_length() if len(s) else 0)
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def sort_keys(s: np.ndarray) -> np.ndarray:
    """Two longs for each sort.  The hash space is cut into ranges; 16 bits of
    the least hash of a range make a digit, and each sort takes eight digits
    from another place on."""
    if not len(s):
        return np.zeros(2 * SORTS, np.uint64)
    edges = np.searchsorted(s, np.arange(RANGES, dtype=np.uint64) << np.uint64(64 - (RANGES.bit_length() - 1)))
    some = np.diff(np.append(edges, len(s))) > 0
    digit = np.where(some, s[np.minimum(edges, len(s) - 1)] & np.uint64(0xFFFF), np.uint64(0))
    at = (np.arange(SORTS)[:, None] * (RANGES // SORTS) + np.arange(8)) % RANGES
    places = np.array([48, 32, 16, 0], np.uint64)
    return (digit[at].reshape(2 * SORTS, 4) << places).sum(axis=1, dtype=np.uint64)


def hot_shingles(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles, rarest first: at most ``HOT``, so that the
    list stays below a megabyte.  Each chunk of texts reports the shingles that
    several of its distinct sets carry; the counts are added up in Spark."""
    def work(batches):
        import pyarrow as pa

        def report(sets):
            tokens, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
            often = counts >= CHUNK_LEAST
            return pa.record_batch([pa.array(tokens[often].view(np.int64)), pa.array(counts[often].astype(np.int64))],
                                   names=["token", "n"])

        sets, seen, size = [], set(), 0
        for b in batches:
            for s in shingle_sets(b.column("text").to_pylist()):
                key = hash(s.tobytes())
                if len(s) and key not in seen:
                    seen.add(key)
                    sets.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield report(sets)
                    sets, seen, size = [], set(), 0
        yield report(sets)

    counts = arrow_rows(docs.select("text"), lean(work), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "token").limit(HOT).toPandas()
    return top["token"].to_numpy(np.int64).view(np.uint64)[::-1].copy()


def prefixes(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, digest, prefix, pdig, sketch, wide, keys), written once."""
    spark = docs.sparkSession
    by_count = hot_shingles(docs)
    shared = spark.sparkContext.broadcast(by_count)  # at most HOT longs

    def work(batches):
        import pyarrow as pa

        by_count = shared.value
        rank = np.argsort(by_count)
        hot = by_count[rank]
        for b in batches:
            n, digest, prefix, pdig, sketch, wide, keys = [], [], [], [], [], [], []
            for s in shingle_sets(b.column("text").to_pylist()):
                p = _ordered(s, hot, rank)[:prefix_length(len(s))]
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefix.append(p.view(np.int64))
                pdig.append(hashlib.blake2b(p.tobytes(), digest_size=16).digest())
                keys.append(sort_keys(s).view(np.int64).tolist())
                w = parity_sketch(s)
                wide.append(w)
                sketch.append(np.bitwise_xor.reduce(w.reshape(-1, SKETCH_WORDS), axis=0))
            at = np.concatenate([[0], np.cumsum([len(p) for p in prefix])]).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int64), *prefix])
            yield pa.record_batch([
                b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(pa.array(at), pa.array(flat)), pa.array(pdig, pa.binary()),
                pa.array(sketch, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n", "digest", "prefix", "pdig", "sketch", "wide", "keys"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()),
                           T.StructField("digest", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
                           T.StructField("pdig", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType())),
                           T.StructField("wide", T.ArrayType(T.LongType())),
                           T.StructField("keys", T.ArrayType(T.LongType()))])
    rows = arrow_rows(docs.select("doc_id", "text"), lean(work), schema)
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "prefixes")


def _least_overlap(a: Column, b: Column) -> Column:
    """Shingles that linked sets of these sizes share at least."""
    return F.ceil((NUM * (a + b)) / F.lit(NUM + DEN))


def _sizes_fit(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _sketches_fit(a: str, b: str, na: Column, nb: Column) -> Column:
    """Sizes that fit make sketches of equal width or one of twice the other."""
    words = F.least(F.size(a), F.size(b))
    xor = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))

    def folded(w):
        return F.when(F.size(w) == words, F.col(w)).otherwise(xor(F.slice(w, 1, words), F.slice(w, words + 1, words)))

    differ = F.aggregate(F.transform(xor(folded(a), folded(b)), lambda x: F.bit_count(x)), F.lit(0), lambda t, x: t + x)
    return differ <= na + nb - 2 * _least_overlap(na, nb)


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, name: str) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets link.  ``nodes`` gives the
    (row, doc_id, digest) of each node.  Each text of ``a`` meets its ``b`` in
    groups of about ``MEMBERS``; a text is shuffled once for each pair."""
    pairs = stored(pairs, f"{name}-pairs")
    # how many partners each a has decides over how many groups they are dealt
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    dealt = pairs.join(per, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"),
                                        F.col("b").alias("row"), F.lit(False).alias("first"))
    firsts = per.select("a", F.explode(F.expr("sequence(0L, parts - 1L)")).alias("part"),
                        F.col("a").alias("row"), F.lit(True).alias("first"))
    wanted = stored(dealt.unionByName(firsts).join(nodes.select("row", "doc_id", "digest"), "row"), f"{name}-wanted")
    ids = small(wanted.select(F.col("doc_id").alias("_d")).distinct())
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_d"), "left_semi")
    rows = texts.join(wanted, "doc_id").select("a", "part", "row", "first", "digest", "text")

    def check(key, group):
        import pyarrow as pa

        centre, members = None, {}
        sets = shingle_sets(group.column("text").to_pylist())
        for row, first, digest, s in zip(*(group.column(c).to_pylist() for c in ("row", "first", "digest")), sets):
            if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != digest:
                raise ValueError("a text has changed while it was read")
            if first:
                centre = s
            else:
                members[row] = s
        found = sorted(r for r, s in members.items() if linked(centre, s))
        return pa.table([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["a", "b"])

    return rows.groupBy("a", "part").applyInArrow(check, "a long, b long")


def _labels(sets: DataFrame, links: DataFrame | None, name: str) -> DataFrame:
    """(row, node, comp) of all rows that have a set."""
    nodes = sets.groupBy("n", "digest").agg(F.min("row").alias("node"))
    rows = sets.join(nodes, ["n", "digest"]).select("row", "node")
    if links is None:
        return rows.withColumn("comp", F.col("node"))
    comp = components(links, name).select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    return rows.join(comp, F.col("node") == F.col("_n"), "left").select(
        "row", "node", F.coalesce("_c", "node").alias("comp"))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: for every node up to ``PARTNERS`` others that stand within
    ``AHEAD`` places of it in a sort and pass the size and sketch filters, those
    with the nearest sketches.

    The sorts are range-partitioned by all digits, so a large family is spread
    over many tasks; a pair across the border of two is left to step 3."""
    rows = nodes.select("row", "n", "sketch", F.explode(F.array(*[
        F.struct(F.lit(i).alias("s"), F.get("keys", F.lit(2 * i)).alias("k"), F.get("keys", F.lit(2 * i + 1)).alias("l"))
        for i in range(SORTS)])).alias("_k")).select("row", "n", "sketch", "_k.*")
    order = ["s", "k", "l", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n", "sketch", "s")

    def work(batches):
        import pyarrow as pa

        tail = None
        for b in batches:
            row, n, s = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "n", "s"))
            sk = b.column("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, SKETCH_WORDS)
            if tail is not None:
                row, n, s, sk = (np.concatenate([x, y]) for x, y in zip(tail, (row, n, s, sk)))
            old, m = (0 if tail is None else len(tail[0])), len(row)
            # how far row i is from the one d places on, if the filters let the pair pass
            far = np.iinfo(np.int32).max
            ahead = np.full((m, AHEAD), far, np.int32)
            for d in range(1, min(AHEAD, m - 1) + 1):
                i = np.arange(max(0, old - d), m - d)  # pairs of two old rows were seen before
                j = i + d
                differ = np.bitwise_count(sk[i] ^ sk[j]).sum(axis=1, dtype=np.int32)
                na, nb = n[i], n[j]
                need = -(-NUM * (na + nb) // (NUM + DEN))
                ok = (s[i] == s[j]) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb)) & (differ <= na + nb - 2 * need)
                ahead[i, d - 1] = np.where(ok, differ, far)
            behind = np.full((m, AHEAD), far, np.int32)
            for d in range(1, min(AHEAD, m - 1) + 1):
                behind[d:, d - 1] = ahead[:m - d, d - 1]
            found = []
            for table, sign in ((ahead, 1), (behind, -1)):
                k = np.argsort(table, axis=1, kind="stable")[:, :PARTNERS]
                i, c = np.nonzero(np.take_along_axis(table, k, axis=1) < far)
                j = i + sign * (k[i, c] + 1)
                found.append((row[i], row[j], table[i, k[i, c]]))
            x, y, d = (np.concatenate(f) for f in zip(*found))
            # both ends may want the pair
            yield pa.record_batch([pa.array(np.concatenate([x, y])), pa.array(np.concatenate([y, x])),
                                   pa.array(np.concatenate([d, d]).astype(np.int64))], names=["a", "b", "d"])
            tail = tuple(x[-AHEAD:] for x in (row, n, s, sk))

    near = arrow_rows(rows, lean(work), "a long, b long, d long").distinct()
    # at most a few partners from each place in each sort
    best = near.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "a"))), 1, PARTNERS).alias("_m"))
    best = best.select("b", F.explode("_m").alias("_m")).select(F.col("_m.a").alias("a"), "b")
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _fitting(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that pass the size and sketch filters."""
    side = lambda x: nodes.select(F.col("row").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"s{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(_sizes_fit(F.col("na"), F.col("nb"))
                      & _sketches_fit("sa", "sb", F.col("na"), F.col("nb"))).select("a", "b")


def group_pairs(groups: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of groups (row, n, prefix, comp), a the smaller,
    that share a prefix shingle across components and pass the size and
    position filters.

    The smaller of two linked sets has the first common shingle among the first
    ``n / 9`` of its prefix (``need`` below for equal sizes); sizes are within a
    factor of 1.25, so equal or neighbouring classes on that scale.  Shingles
    that can't give a pair are dropped by an aggregate combined before the
    shuffle; for the others the components of a shingle and size class are
    paired first, so members of a large component are never paired among
    themselves."""
    n, pos = F.col("n"), F.col("pos")
    rows = groups.select("row", "n", "comp", F.posexplode("prefix").alias("pos", "token"))
    early = n - pos >= _least_overlap(n, n)
    across = stored(rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(early).alias("early"))
                    .where("lo <> hi AND early").select(F.col("token").alias("_t")), "shared-shingles")
    # classes are a little wider than the largest ratio of linked sizes, so these are at most one class apart
    size_class = F.floor(F.log(n.cast("double")) / F.log(F.lit(1.01 * DEN / NUM))).cast("int")
    met = stored(rows.join(small(across, BROADCAST_SHINGLES), F.col("token") == F.col("_t")).drop("_t")
                 .withColumns({"class": size_class, "early": early}), "shared-rows")
    smaller = met.where("early").withColumn("class", F.explode(F.array(F.col("class"), F.col("class") + 1)))
    keys = ["token", "class"]
    of_a = smaller.groupBy(*keys, F.col("comp").alias("ca")).agg(F.count("*").alias("ma"))
    of_b = met.groupBy(*keys, F.col("comp").alias("cb")).agg(F.count("*").alias("mb"))
    pairs = of_a.join(of_b, keys).where("ca <> cb")
    side = lambda rows, x: rows.select(*keys, F.col("comp").alias(f"c{x}"), F.col("row").alias(x),
                                       F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"))
    na, nb = F.col("na"), F.col("nb")
    need = _least_overlap(na, nb)
    fits = (((na < nb) | ((na == nb) & (F.col("a") < F.col("b")))) & _sizes_fit(na, nb)
            & (na - F.col("pa") >= need) & (nb - F.col("pb") >= need))
    # the component with fewer members is expanded first, the filters stand on the second join
    on_a, on_b = [*keys, "ca"], [*keys, "cb"]
    few_a = pairs.where("ma <= mb").join(side(smaller, "a"), on_a).join(side(met, "b"), on_b)
    few_b = pairs.where("ma > mb").join(side(met, "b"), on_b).join(side(smaller, "a"), on_a)
    return few_a.where(fits).select("a", "b").unionByName(few_b.where(fits).select("a", "b")).distinct()


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Rows are told apart by their id.  Where ids are null or repeated, the texts
    are written once with a number each and the rows are joined by that, so that
    rows of one id never meet as a product."""
    docs = docs.select("doc_id", "text")
    ids = docs.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["n"] == ids["ids"]:
        rows = _labelled(docs)
    else:
        numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
        found = _labelled(numbered.select(F.col("row").alias("doc_id"), "text"))
        rows = found.withColumnRenamed("doc_id", "row").join(numbered.select("row", "doc_id"), "row")
    rows = stored(rows.select("doc_id", "n", "comp"), "labelled")
    # only components of several rows are looked up, so singles stay where they are
    least = rows.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    out = rows.join(small(stored(least, "least")), "comp", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, comp) of documents with unique ids."""
    table = prefixes(docs)
    sets = table.where("n > 0")
    first = stored(_labels(sets.select("row", "n", "digest"), None, "copies"), "copies")
    reps = small(first.where("row = node").select(F.col("row").alias("_r")))
    nodes = sets.join(reps, F.col("row") == F.col("_r"), "left_semi")

    near = stored(verify(near_pairs(nodes), docs, nodes, "near"), "near-links")
    labels = stored(_labels(sets.select("row", "n", "digest"), near, "near"), "near-labels")
    own = labels.where("row = node").select(F.col("row").alias("_r"), "comp")
    # group: nodes of one component with equal size and prefix, named by the least
    member = stored(nodes.select("row", "n", "pdig", "doc_id", "digest").join(own, F.col("row") == F.col("_r")).drop("_r"), "members")
    grouped = member.groupBy("n", "pdig", "comp").agg(F.min("row").alias("grp"))
    members = stored(member.join(grouped, ["n", "pdig", "comp"]).select("grp", "row"), "groups")
    heads = small(grouped.select(F.col("grp").alias("_g"), "comp"))
    groups = sets.select("row", "n", "prefix").join(heads, F.col("row") == F.col("_g")).drop("_g")

    side = lambda g, x: members.select(F.col("grp").alias(g), F.col("row").alias(x))
    cand = (group_pairs(groups).withColumnsRenamed({"a": "ga", "b": "gb"})
            .join(side("ga", "a"), "ga").join(side("gb", "b"), "gb").select("a", "b"))
    more = stored(verify(_fitting(cand, nodes), docs, nodes, "group"), "group-links")
    links = near.unionByName(more)
    final = _labels(sets.select("row", "n", "digest"), links, "all") if more.limit(1).count() else labels

    return table.select("row", "doc_id", "n").join(final, "row", "left").select("doc_id", "n", F.coalesce("comp", "row").alias("comp"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component stays: the least id's, and of its repeated rows
    the one with the least number.  Rows without words are components of their own."""
    # the row is kept in a struct, so that no column of its own can be overwritten
    numbered = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
                                  F.monotonically_increasing_id().alias("_row")), "numbered")
    found = jaccard_components(numbered.select(F.col("_row").alias("doc_id"), "doc.text"))
    found = found.select(F.col("doc_id").alias("_r"), "component_id")
    doc_id = F.col("doc.doc_id")
    first = F.min(F.struct(doc_id.isNull(), doc_id.alias("doc_id"), "_row"))["_row"]
    keep = (numbered.select("doc.doc_id", "_row", F.struct("doc.doc_id").alias("doc")).join(found, F.col("_row") == F.col("_r"))
            .groupBy("component_id").agg(first.alias("_k")).select("_k"))
    out = numbered.join(small(stored(keep, "kept-rows")), F.col("_row") == F.col("_k"), "left_semi")
    return out.select(*[F.col("doc")[c].alias(c) for c in docs.columns])


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + least(len(ws), 5) - 1) AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
         GROUP BY 1, 2),
e AS (SELECT x, y FROM met JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
u AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.y, r.c FROM r JOIN u ON u.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m
  ON m.doc_id = d.doc_id
"""
