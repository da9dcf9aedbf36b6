"""N-gram Jaccard join by prefix trees.

A document is the set of its distinct 5-word shingles (with fewer words: the whole sequence as one). Two
documents link if 100 * |A and B| >= 80 * |A or B|. The steps:

1. Documents of equal sets are one class; a class takes part once.
2. One global order of all shingles: those seen to be frequent last, by the power of two of their count, and
   by hash otherwise. The counts are sums over hash buckets of a fixed number, gathered over all documents;
   they only steer the order, any order gives the same links.
3. Prefix filter: two sets that link share one of their first n - ceil(0.8 n) + 1 shingles. Classes that
   share such a shingle are candidates.
4. Stars: in every candidate group the class that shares most is looked up against the others. Links found
   here join most of a group of near copies without the pairs inside it.
5. Rest: what still is in different components but shares a prefix shingle is looked up: the members of the
   smaller component against prefix trees of the larger one, in parts of bounded size.

A look-up inserts the candidate sets in global order into a prefix tree with joined paths. The traversal
counts the overlap once for all sets that share a path, and leaves out a subtree when what is left of the
probe and of the sets below cannot reach the needed overlap.

Pairs inside a component that is already joined are not looked up: they cannot change the components.

Defined results: NULL and blank texts have an empty set, link with nothing and are their own component;
repeated rows are equal sets; a row without id takes the smallest id of its component, or NULL if there is
none; an empty table gives no rows; other columns are ignored.
"""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablekeeper.llm import hashing
from tablekeeper.llm.components import components
from tablekeeper.llm.tables import load, staged

ORDER = 5
#: Buckets of the counts that steer the order: 2 ** 24 levels of one byte each are sent to all tasks.
BUCKET_BITS = 24
#: Sets in one prefix tree, and postings of a frequent shingle in one part.
TREE_SETS = 256
PART_POSTINGS = 4096
LEVEL_BITS = 6
#: Places of the bitmap of looked-up ids: at most 2 ** 18 rows of 64 bits are sent to all tasks.
MARK_BITS = 24


# --- sets ----------------------------------------------------------------------------------------

def shingle_sets(column, order=ORDER):
    """The sorted distinct shingle hashes of each row of an Arrow text column."""
    words, bounds = hashing.word_hashes(column)
    chains = hashing.chained(words, order)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= order:
            out.append(np.unique(chains[a:b - order + 1]))
        elif b > a:
            out.append(hashing.chained(words[a:b], int(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def class_of(hashes):
    """64-bit digest of a set."""
    return hashing.mixed(np.sum(hashing.mixed(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)
                         + np.full(1, len(hashes), np.uint64)).view(np.int64)[0]


def global_keys(hashes, levels):
    """The set as sorted positions in the global order: level above, hash below."""
    level = levels[hashes >> np.uint64(64 - BUCKET_BITS)].astype(np.uint64)
    return np.sort((level << np.uint64(64 - LEVEL_BITS)) | (hashes >> np.uint64(LEVEL_BITS)))


def _slim(docs):
    """One row per document (``doc_id``, ``n``, ``cid``), and per task the buckets that stand out."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        counts, total = np.zeros(1 << BUCKET_BITS, np.int32), 0
        id_type = None
        for batch in hashing.small_batches(batches):
            sets = shingle_sets(batch.column("text"))
            id_type = batch.schema.field("doc_id").type
            every = np.concatenate(sets) >> np.uint64(64 - BUCKET_BITS)
            total += len(every)
            np.add.at(counts, every.astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                pa.array([class_of(x) for x in sets], pa.int64()), pa.nulls(len(sets), pa.int32()),
            ], ["doc_id", "n", "cid", "bucket"])
        found = np.flatnonzero(counts >= 2 * total / len(counts) + 3)
        if len(found):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(found), id_type), pa.array(counts[found].astype(np.int64)),
                pa.nulls(len(found), pa.int64()), pa.array(found.astype(np.int32)),
            ], ["doc_id", "n", "cid", "bucket"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, cid long, bucket int")


def _levels(slim):
    """Level of each bucket, at most 2 ** BUCKET_BITS bytes, sent to all tasks."""
    found = slim.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    levels = np.zeros(1 << BUCKET_BITS, np.uint8)
    n = found.column("n").to_numpy()
    levels[found.column("bucket").to_numpy()] = np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64) + 1, 63)
    return slim.sparkSession.sparkContext.broadcast(levels)


def _postings(docs, levels):
    """(``token``, ``cid``, ``at``, ``parts``): the prefix shingles of each set with their positions in the
    order; ``parts`` over 1 marks frequent ones."""

    def run(batches):
        import pyarrow as pa

        known = levels.value
        for batch in hashing.small_batches(batches):
            tokens, owners, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
            for hashes in shingle_sets(batch.column("text")):
                n = len(hashes)
                if n > 1:
                    keys = global_keys(hashes, known)[:n - -(-4 * n // 5) + 1]
                    tokens.append(keys)
                    owners.append(np.full(len(keys), class_of(hashes)))
                    places.append(np.arange(len(keys), dtype=np.int32))
            token = np.concatenate(tokens)
            level = (token >> np.uint64(64 - LEVEL_BITS)).astype(np.int64)
            parts = np.maximum(1, (1 << np.minimum(level, 40)) // PART_POSTINGS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(np.concatenate(owners)),
                 pa.array(np.concatenate(places)), pa.array(parts)],
                ["token", "cid", "at", "parts"],
            )

    return docs.select("text").mapInArrow(run, "token long, cid long, at int, parts long")


def _shared(postings, tasks):
    """(``token``, ``cid``, ``at``) of the prefix shingles that several classes have.

    Rows go around once. A frequent shingle is cut into parts beforehand and is always kept.
    """
    part = F.when(F.col("parts") > 1, F.pmod(F.col("cid"), F.col("parts"))).otherwise(F.lit(0))
    own = Window.partitionBy("token", "part")
    once = postings.withColumn("part", part).repartition(tasks, "token", "part").groupBy(
        "token", "part", "cid").agg(F.min("at").alias("at"), F.max("parts").alias("parts"))
    return once.withColumn("low", F.min("cid").over(own)).withColumn("high", F.max("cid").over(own)).where(
        "low != high OR parts > 1").select("token", "cid", "at")


def _maybe(docs, wanted):
    """The rows of ``docs`` whose id may be among those of ``wanted``, by a bitmap of 2 ** MARK_BITS places.

    Every wanted row stays; the others mostly go before their sets are built and exchanged. Where the
    bitmap is full, all rows stay.
    """
    place = lambda name: F.pmod(F.xxhash64(name), F.lit(1 << MARK_BITS))
    bit = F.expr("shiftleft(1L, cast(place % 64 as int))")
    marks = wanted.select(place("doc_id").alias("place")).groupBy(
        F.expr("place div 64").alias("word")).agg(F.bit_or(bit).alias("bits"))
    texts = docs.select(F.col("doc_id").alias("own"), "text").withColumn("at", place("own"))
    return texts.join(F.broadcast(marks), F.expr("at div 64 = word")).where(
        F.getbit("bits", (F.col("at") % 64).cast("int")) == 1).select("own", "text")


def _with_sets(docs, asked, classes, levels):
    """``asked`` (``cid`` and more) with the ``keys`` of each class, from the text of one document of it.

    Rows that repeat an id may give a class twice, which changes no link.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        known = levels.value
        for batch in hashing.small_batches(batches):
            sets = shingle_sets(batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("own"), pa.array([class_of(x) for x in sets], pa.int64()),
                pa.array([global_keys(x, known).tobytes() for x in sets], pa.binary()),
            ], ["own", "own_class", "keys"])

    asked = staged(asked.join(classes.select("cid", "doc_id"), "cid"), "asked")  # its size tells Spark how to join
    found = _maybe(docs, asked).mapInArrow(run, f"own {kind}, own_class long, keys binary")
    same = (F.col("own_class") == F.col("cid")) & F.col("own").eqNullSafe(F.col("doc_id"))
    return found.join(asked, same).drop("own", "own_class", "doc_id")


# --- the prefix tree -----------------------------------------------------------------------------

class PrefixTree:
    """Sets of ascending keys on joined paths; a node has its parent, its own keys and bounds of sizes."""

    def __init__(self, sets):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.keys, self.children, self.ends = [np.empty(0, np.uint64)], [[]], [[]]
        self.depth = [0]
        path, last = [0], np.empty(0, np.uint64)
        for i in self.order:
            keys = sets[i]
            m = min(len(last), len(keys))
            differ = np.flatnonzero(last[:m] != keys[:m])
            same = int(differ[0]) if len(differ) else m
            while len(path) > 1 and self.depth[path[-2]] >= same:
                path.pop()
            top = path[-1]
            if self.depth[top] > same:  # the paths part inside this node
                top = self._split(path[-2], top, same)
                path[-1] = top
            if len(keys) > self.depth[top]:
                node = self._add(keys[self.depth[top]:], len(keys))
                self.children[top].append(node)
                path.append(node)
                top = node
            self.ends[top].append(i)
            last = keys
        n = len(self.keys)
        self.least, self.most = [1 << 60] * n, [0] * n
        for node in self._bottom_up():
            sizes = [self.depth[node]] if self.ends[node] else []
            self.least[node] = min(sizes + [self.least[c] for c in self.children[node]], default=1 << 60)
            self.most[node] = max(sizes + [self.most[c] for c in self.children[node]], default=0)

    def _add(self, keys, depth):
        self.keys.append(keys)
        self.children.append([])
        self.ends.append([])
        self.depth.append(depth)
        return len(self.keys) - 1

    def _split(self, parent, node, depth):
        """Put a node at ``depth`` between parent and node."""
        cut = len(self.keys[node]) - (self.depth[node] - depth)
        middle = self._add(self.keys[node][:cut], depth)
        self.keys[node] = self.keys[node][cut:]
        self.children[middle].append(node)
        self.children[parent][self.children[parent].index(node)] = middle
        return middle

    def _bottom_up(self):
        order, stack = [], [0]
        while stack:
            node = stack.pop()
            order.append(node)
            stack.extend(self.children[node])
        return reversed(order)

    def linked(self, probe, first=False):
        """Indices of the sets that link with the probe; with ``first``, at most one of them."""
        n, out = len(probe), []
        stack = [(c, 0) for c in self.children[0]]
        while stack:
            node, overlap = stack.pop()
            if 9 * min(n, self.most[node]) < 4 * (n + self.least[node]):
                continue
            keys = self.keys[node]
            at = np.searchsorted(probe, keys)
            overlap += int(np.count_nonzero(probe[np.minimum(at, n - 1)] == keys))
            left = n - int(np.searchsorted(probe, keys[-1], "right"))
            if 9 * (overlap + min(left, self.most[node] - self.depth[node])) < 4 * (n + self.least[node]):
                continue
            if self.ends[node] and 9 * overlap >= 4 * (n + self.depth[node]):
                out.extend(self.ends[node])
                if first:
                    return out[:1]
            stack.extend((c, overlap) for c in self.children[node])
        return out


def _look_up(rows, tasks, first):
    """Links (``a``, ``b``) of probes with the sets of their trees.

    ``rows`` have ``tree``, ``part``, ``role`` (0 in the tree, 1 probe), ``cid`` and ``keys``. The rows of a
    tree come first, so that a task holds one tree at a time and lets the probes stream past.
    """
    columns = ("tree", "part", "role", "cid", "keys")

    def run(batches):
        import pyarrow as pa

        held, sets, owners, tree = None, [], [], None
        for batch in batches:
            a, b = [], []
            names = [batch.column(c).to_pylist() for c in columns[:4]]
            keys = batch.column("keys")
            for i, (top, part, role, cid) in enumerate(zip(*names)):
                if (top, part) != held:
                    held, sets, owners, tree = (top, part), [], [], None
                own = np.frombuffer(keys[i].as_py(), np.uint64)
                if role == 0:
                    sets.append(own)
                    owners.append(cid)
                    continue
                if tree is None:
                    tree = PrefixTree(sets)
                for j in tree.linked(own, first):
                    a.append(cid)
                    b.append(owners[j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.select(*columns).repartition(tasks, "tree", "part").sortWithinPartitions("tree", "part", "role").mapInArrow(
        run, "a long, b long")


# --- the join ------------------------------------------------------------------------------------

def _least_shared(n, low, high):
    """Fewest prefix shingles that a set of size ``n`` shares with a linked one of size ``low`` to ``high``.

    Of the set whose prefix ends first, at most n minus the overlap are not in the other, and the rest of its
    prefix lies within the other's. NULL where no size in the range can link.
    """
    fifth = lambda x: F.ceil(x * 4 / 5)
    low = F.greatest(low, fifth(n))
    high = F.least(high, F.floor(n * 5 / 4))
    overlap = lambda x: F.ceil((n + x) * 4 / 9)
    bound = F.least(overlap(low) - fifth(n) + 1, overlap(high) - fifth(high) + 1)
    # Roundings may shift each term by one.
    return F.when(low <= high, F.greatest(F.lit(1), bound - 2))


def _star_pairs(lists):
    """(``tree``, ``cid``): every class beside the class that shares most of its prefix in one of its groups."""
    score = F.size("tokens") / (F.floor(F.col("n") / 5) + 1)
    rows = lists.select("cid", score.alias("score"), F.explode("tokens").alias("token"))
    tops = rows.groupBy("token").agg(F.max(F.struct("score", "cid")).alias("top"))
    pairs = rows.select("cid", "token").join(tops, "token").select(F.col("top.cid").alias("tree"), "cid").where(
        "tree != cid").distinct()
    return _enough_shared(pairs, lists)


def _enough_shared(pairs, lists):
    """The pairs of classes (``tree``, ``cid``) that share as many prefix shingles as linked ones must."""
    tree = lists.select(F.col("cid").alias("tree"), F.col("n").alias("m"), F.col("tokens").alias("others"))
    return pairs.join(lists.drop("places"), "cid").join(tree, "tree").where(
        F.size(F.array_intersect("tokens", "others")) >= _least_shared(F.col("n"), F.col("m"), F.col("m"))
    ).select("tree", "cid")


def _every_part(rows):
    """A row for each part of its tree."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))


def _roles(members, probes):
    """The rows of one look-up, without their sets."""
    own_part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    return members.select("tree", own_part.alias("part"), F.lit(0).alias("role"), "cid").unionByName(
        _every_part(probes).select("tree", "part", F.lit(1).alias("role"), "cid"))


def _star_rows(pairs):
    """Look-ups of each star's centre among its members."""
    size = pairs.groupBy("tree").agg(F.ceil(F.count("*") / TREE_SETS).alias("parts"))
    return _roles(pairs.join(size, "tree"), size.withColumn("cid", F.col("tree")))


def _rest_probes(own, lists):
    """(``cid``, ``tree``): members of smaller components beside the larger ones they may link with.

    The first shingle that two linked sets have in common lies so early in both that enough are left.
    """
    at = lists.select("cid", F.arrays_zip("tokens", "places").alias("x")).join(own, "cid").select(
        "*", F.explode("x").alias("y")).select(
        F.col("y.tokens").alias("token"), F.col("y.places").alias("at"), *own.columns)
    # Groups that lie in one component have nothing left to find.
    groups = at.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where(
        "low != high").select("token")
    open_ = staged(at.join(groups, "token", "left_semi").select(
        "token", "cid", "at", "n", "component", "size", "least", "most"), "open")
    tops = open_.groupBy(
        "token", F.col("component").alias("tree"), F.col("size").alias("tree_size"),
        F.col("least").alias("tree_least"), F.col("most").alias("tree_most"),
    ).agg(F.min("at").alias("tree_at"))
    n, low, high = F.col("n"), F.col("tree_least"), F.col("tree_most")
    low, high = F.greatest(low, F.ceil(n * 4 / 5)), F.least(high, F.floor(n * 5 / 4))
    overlap = lambda x: F.ceil((n + x) * 4 / 9)
    pairs = open_.alias("o").join(
        tops.alias("t"), (F.col("o.token") == F.col("t.token"))
        & (F.struct("tree_size", "tree") > F.struct("size", "component")) & (low <= high)
        & (F.col("at") <= n - overlap(low)) & (F.col("tree_at") <= high - overlap(high)),
    ).select("cid", "tree", "tree_size").distinct()
    pairs = staged(pairs, "rest-pairs")
    single = _enough_shared(pairs.where("tree_size = 1").select("tree", "cid"), lists)
    return pairs.where("tree_size > 1").select("tree", "cid").unionByName(single)


def _rest_rows(probes, own):
    """Look-ups of probes among the components of their trees."""
    trees = probes.select("tree").distinct().join(
        own.groupBy(F.col("component").alias("tree")).agg(F.ceil(F.count("*") / TREE_SETS).alias("parts")), "tree")
    members = own.select("cid", F.col("component").alias("tree")).join(trees, "tree")
    return _roles(members, probes.select("cid", "tree").join(trees, "tree"))


def joined(docs):
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    slim = staged(_slim(docs), "shingles")
    levels = _levels(slim)
    rows = slim.where("bucket IS NULL").drop("bucket")
    classes = staged(
        rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n")), "classes")
    # One document of each class has its postings: copies would only repeat them.
    shared = _shared(_postings(_maybe(docs, classes), levels), tasks)

    lists = shared.groupBy("cid").agg(F.collect_list(F.struct("token", "at")).alias("x")).join(
        classes.select("cid", "n"), "cid")
    lists = staged(lists.select("cid", "n", F.col("x.token").alias("tokens"), F.col("x.at").alias("places")), "lists")
    pairs = staged(_star_pairs(lists), "star-pairs")
    stars = staged(_look_up(_with_sets(docs, _star_rows(pairs), classes, levels), tasks, False), "stars")

    labels = components(stars).withColumnRenamed("id", "cid")
    own = lists.select("cid", "n").join(labels, "cid", "left").select(
        "cid", "n", F.coalesce("component", "cid").alias("component"))
    sizes = own.groupBy("component").agg(
        F.count("*").alias("size"), F.min("n").alias("least"), F.max("n").alias("most"))
    own = staged(own.join(sizes, "component"), "candidates")
    probes = staged(_rest_probes(own, lists), "probes")
    rest = staged(_look_up(_with_sets(docs, _rest_rows(probes, own), classes, levels), tasks, True), "rest")

    # The stars are shallow by now: each class hangs on its component.
    links = own.select(F.col("cid").alias("a"), F.col("component").alias("b")).unionByName(rest)
    labels = components(links).withColumnRenamed("id", "cid")
    named = classes.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(least, "component").select("cid", "component_id")
    full = rows.where("n > 0").join(by_class, "cid").select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def op9_jaccard_join(spark, folder):
    """The contract's columns for all of ``documents``."""
    return joined(load(spark, folder, "documents"))


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS g
  FROM d, generate_series(0, greatest(len(d.w) - 5, 0)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY 1, 2) JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * k >= 80 * (na.n + nb.n - k)),
r(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""
