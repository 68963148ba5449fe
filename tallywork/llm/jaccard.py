"""N-gram Jaccard join by prefix filters under several global token orders."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import among, bounded, components, cut, map_rows, matching, slices

#: Words hashed once and remembered by a Python worker; a full memory is emptied.
MEMO = 500_000
#: An order ranks the tokens whose two low bits are its number first, by how many documents hold them, then all others by their value.
ORDERS = (0, 1, 2, 3)
#: Documents of one block of a candidate group; two blocks meet in one task. Members of larger groups meet hubs first.
BLOCK = 256
#: A token found in OFTEN documents of a sample, a SAMPLE-th of all, is ranked last, uncounted; so about OFTEN x SAMPLE documents at most are
#: counted for a token, at any size of the table.
OFTEN, SAMPLE = 16, 64
#: Sets of a group of more than BLOCK to which all others are compared first, and the size from which the further orders split a group before that:
#: splitting ships whole sets once more for each order, which smaller groups don't repay.
HUBS, WIDE_GROUP = 8, 65_536
#: Rows of a table that is broadcast: some such tables stay in the driver at once, at any size of the documents.
FEW = 20_000
#: Tokens by which two blocks are multiplied at a time.
WIDE = 4096

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_memo: dict[bytes, int] = {}


def shingles(text: str | None, size: int = 3) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of `size` words, A-Z in lower case; of all words if there are fewer; empty without words."""
    words = (text or "").encode().lower().split()  # bytes.lower knows A-Z alone, bytes.split ASCII white space
    if len(_memo) > MEMO:
        _memo.clear()
    try:
        h = [_memo[w] for w in words]
    except KeyError:
        for w in words:
            if w not in _memo:
                _memo[w] = xxhash.xxh64_intdigest(w)
        h = [_memo[w] for w in words]
    if not h:
        return np.zeros(0, np.int64)
    a, k = np.array(h, np.uint64), min(size, len(h))
    out = np.full(len(a) - k + 1, np.uint64(k))
    for i in range(k):
        out = (out + a[i : len(a) - k + 1 + i]) * _K[i % 3]
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def linked(common, n: int, m: int, percent: int):
    return 100 * common >= percent * (n + m - common)


def prefix_size(n: int, percent: int) -> int:
    """Of n tokens: two sets that link share one of these first tokens of each, whatever the order."""
    return n - -(-percent * n // 100) + 1


def prefix_pool(tokens: np.ndarray, order: int, percent: int) -> tuple[np.ndarray, int]:
    """(the order's first tokens, prefix size less their number): all that it ranks by count; if the prefix needs more, the next ones too."""
    own = (tokens & 3) == order
    first, need = tokens[own], prefix_size(len(tokens), percent)
    if need > len(first):
        first = np.concatenate([first, tokens[~own][: need - len(first)]])
    return first, need - len(first)


def order_groups(pools: DataFrame, order: int, name: str) -> DataFrame:
    """(key, grp): sets that share prefix tokens, directly or through others, under one order; those that share none are left out.

    pools: (key long, short int, tokens array<long>) as from prefix_pool; rows with one key are alike and count as one set in the end. Rare tokens come first, by
    the number of rows. Tokens found often in a sample of documents, which decides nothing but the order, come last and are not counted.
    """
    often = pools.where(F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0).select(F.explode("tokens").alias("token")).groupBy("token").count()
    often = bounded(cut(often.where(F.col("count") >= OFTEN).select("token"), f"{name}-often"))
    rows = pools.select("key", F.explode("tokens").alias("token"))
    marked = rows.join(often.withColumn("many", F.lit(True)), "token", "left").withColumn("many", F.coalesce("many", F.lit(False)))
    w = Window.partitionBy("many", "part")  # rows of a frequent token are spread by their sets
    told = marked.withColumn("part", F.when(F.col("many"), F.xxhash64("key")).otherwise(F.col("token"))).select("key", "token", "many", F.count("*").over(w).alias("df"), (F.min("key").over(w) != F.max("key").over(w)).alias("shared"))
    shared = told.where("many or shared").select("key", "token", F.when(F.col("many"), F.lit(1 << 40)).otherwise(F.col("df")).alias("df"))
    own = F.when(F.col("token").bitwiseAND(3) == order, F.struct(F.lit(0).alias("tail"), "df", "token")).otherwise(F.struct(F.lit(1).alias("tail"), F.lit(0).cast("long").alias("df"), "token"))
    lists = shared.groupBy("key").agg(F.sort_array(F.collect_set(own)).alias("seen")).join(pools.groupBy("key").agg(F.min("short").alias("short")).hint("merge"), "key")
    take = F.col("short") + F.size("seen")
    prefix = cut(lists.where(take > 0).select("key", F.explode(F.slice("seen", F.lit(1), take)).alias("t")).select("key", F.col("t.token").alias("token")), f"{name}-prefixes")
    hubs = cut(prefix.groupBy("token").agg(F.min("key").alias("hub"), F.max("key").alias("other")).where("hub != other").select("token", "hub"), f"{name}-hubs")
    edges = prefix.join(bounded(hubs, FEW), "token").select(F.col("key").alias("src"), F.col("hub").alias("dst")).distinct()
    return cut(components(edges, f"{name}-components").select(F.col("id").alias("key"), F.col("component").alias("grp")), f"{name}-groups")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from products of 0/1 matrices over the tokens that two sets hold, WIDE at a time."""
    at, n = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), len(sets)
    _, tokens, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[tokens] > 1
    at, tokens = at[keep], tokens[keep]
    out = np.zeros((n, n), np.float32)
    if len(tokens):
        _, tokens = np.unique(tokens, return_inverse=True)
        by = np.argsort(tokens, kind="stable")
        at, tokens = at[by], tokens[by]
        for low in range(0, int(tokens[-1]) + 1, WIDE):
            a, b = np.searchsorted(tokens, [low, low + WIDE])
            m = np.zeros((n, min(WIDE, int(tokens[-1]) + 1 - low)), np.float32)
            m[at[a:b], tokens[a:b] - low] = 1
            out += m @ m.T
    return out.astype(np.int64)


def spanning_links(ids: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between documents of two blocks (side 0 and 1; side 2: all within one), less those that join what others join already."""
    sizes = np.array([len(x) for x in sets])
    common = common_counts(sets)
    hit = linked(common, sizes[:, None], sizes[None, :], percent) & ((side[:, None] != side[None, :]) | (side[:, None] == 2))
    parent, out = list(range(len(ids))), []

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
        if (a := root(int(i))) != (b := root(int(j))):
            parent[b] = a
            out.append((int(ids[i]), int(ids[j])))
    return out


def jaccard_components(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents whose sets of `size`-word shingles have a Jaccard similarity of percent / 100 or
    more are linked; component_id is the smallest doc_id reachable by links, itself included.

    A text with fewer words is one shingle; without words (or null) the set is empty and links with nothing. doc_id must be a whole number;
    rows with equal doc_id are one node. Repeated rows are each returned.

    Equal sets are one class, so copies never meet. Of the classes, candidates share prefix tokens, directly or through others, under the
    first order and under the second (which sees what the first leaves); groups of more than WIDE_GROUP are split by the further orders as well.
    Only classes in one group under all orders are compared, with their whole sets, a task returning links that span what it joins. The
    result is exact: a prefix filter loses no pair, under any order. Other columns are ignored, whatever their names; an empty table gives
    no rows; a very long text is hashed whole by one task.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be over 50 and at most 100")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "doc_id long, n long, digest binary, short int, tokens array<long>"

    def scan(batches):
        seen: set[bytes] = set()  # a class gives its tokens once a partition
        schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("short", pa.int32()), ("tokens", pa.list_(pa.int64()))])
        for part in (part for batch in batches for part in slices(batch)):
            out = [[] for _ in schema]
            for doc, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                s = shingles(text, size)
                digest = blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None
                pool, short = (None, 0) if digest is None or digest in seen else prefix_pool(s, ORDERS[0], percent)
                seen.add(digest)
                for col, x in zip(out, (doc, len(s), digest, short, pool), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    sets = cut(rows.mapInArrow(scan, kind), "shingle-pools")
    classes = cut(sets.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies")), "shingle-classes")
    key = F.xxhash64("digest").alias("key")
    groups = order_groups(sets.where("tokens is not null").select(key, "short", "tokens"), ORDERS[0], "order0")
    left = cut(classes.select("id", "digest", key).join(bounded(groups, FEW), "key").select("id", "digest", "key", "grp"), "shingle-candidates")

    def whole(ids, texts):
        got = [shingles(x, size) for x in texts]
        pools = [prefix_pool(x, ORDERS[1], percent) for x in got]
        return [ids, [blake2b(x.tobytes(), digest_size=16).digest() for x in got], [x.tolist() for x in got], [x[1] for x in pools], [x[0].tolist() for x in pools]]

    texts = matching(rows, cut(left.select(F.col("id").alias("doc_id")).distinct(), "shingle-ids"), "left_semi")
    full = map_rows(texts, "id long, digest binary, set array<long>, short int, tokens array<long>", whole)
    full = cut(full.join(bounded(left, FEW), ["id", "digest"]).dropDuplicates(["id", "digest"]), "shingle-sets")
    second = order_groups(full.select("key", "short", "tokens"), ORDERS[1], "order1")
    both = full.select("id", "key", F.col("grp").alias("grp0")).join(bounded(second.select("key", F.col("grp").alias("grp1")), FEW), "key")
    groups = cut(both.select("id", "key", F.xxhash64("grp0", "grp1").alias("grp")), "shingle-groups")
    sets_of = full.select("id", "key", "set")
    edges = cut(verify(refine(groups, sets_of, percent), sets_of, percent), "shingle-links")
    found = cut(components(edges, "shingle-components"), "shingle-found").select("id", "component")
    named = classes.join(bounded(found, FEW), "id", "left").where("copies > 1 or component is not null").select("digest", F.coalesce("component", "id").alias("component"))
    named = cut(named, "shingle-named")
    out = sets.select("doc_id", "n", "digest").join(bounded(named, FEW), "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.least(F.coalesce("component", "doc_id"), "doc_id").alias("component_id"))


def refine(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """groups (id, key, grp), those of more than WIDE_GROUP split by the orders that are left: members of a group part unless they share prefix tokens,
    directly or through others, under each of them too. A group that stays whole may be one of copies, or chained by chance."""
    for order in ORDERS[2:]:
        large = groups.groupBy("grp").count().where(F.col("count") > WIDE_GROUP).select("grp")
        wide = cut(groups.join(large, "grp", "left_semi"), f"order{order}-wide")
        if not wide.limit(1).count():
            break

        def pool(keys, found, order=order):
            got = [prefix_pool(np.asarray(x, np.int64), order, percent) for x in found]
            return [keys, [x[1] for x in got], [x[0].tolist() for x in got]]

        pools = cut(map_rows(sets.join(bounded(wide.select("id", "key"), FEW), ["id", "key"]).select("key", "set"), "key long, short int, tokens array<long>", pool), f"order{order}-pools")
        part = order_groups(pools, order, f"order{order}").withColumnRenamed("grp", "part")
        split = wide.join(bounded(part, FEW), "key").select("id", "key", F.xxhash64("grp", "part").alias("grp"))
        groups = cut(groups.join(large, "grp", "left_anti").select("id", "key", "grp").unionByName(split), f"order{order}-split")
    return groups


def to_hubs(links: list[tuple[int, int]], hubs: set[int]) -> list[tuple[int, int]]:
    """Links that join the same ids as these, each to the least hub that it reaches; every link has a hub on one side."""
    top: dict[int, int] = {}

    def root(x):
        while top.setdefault(x, x) != x:
            top[x] = x = top[top[x]]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        top[max(a, b, key=lambda x: (x not in hubs, x))] = min(a, b, key=lambda x: (x not in hubs, x))
    return [(x, root(x)) for x in list(top) if root(x) != x]


def compare_blocks(met: DataFrame, sets: DataFrame, percent: int, hubs: bool = False) -> DataFrame:
    """(src, dst): spanning links within each (grp, lo, hi) of met (id, key, grp, own, lo, hi, task): between rows with own lo and own hi, or
    among all if lo and hi are equal. hubs: rows with own lo are hubs, and dst is the least hub that src reaches."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (_, lo, hi), g in pdf.groupby(["grp", "lo", "hi"], sort=False):
            if len(g) > 1:
                side = np.full(len(g), 2) if lo == hi else (g["own"].to_numpy() == hi).astype(int)
                links = spanning_links(g["id"].to_numpy(), side, [np.asarray(x) for x in g["set"]], percent)
                out += to_hubs(links, set(g["id"][g["own"] == lo].tolist())) if hubs else links
        return pd.DataFrame(out, columns=["src", "dst"], dtype="int64")

    rows = met.hint("merge").join(sets, ["id", "key"]).select("grp", "own", "lo", "hi", "task", "id", "set")
    return rows.groupBy("task").applyInPandas(compare, "src long, dst long")


def verify(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(src, dst): links that join, directly or through others, all linked members of each group of groups (id, key, grp).

    A group of up to BLOCK is compared whole. In a larger one all are compared to HUBS members first. What these join needs no further
    comparison among itself: those that reach the same hub are a part. The members outside the largest part are compared to all, block by
    block, each two blocks once.
    """
    sizes = cut(groups.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1"), "shingle-sizes")
    total = sizes.where(f"n <= {BLOCK}").agg(F.sum("n")).first()[0] or 0
    small = groups.join(bounded(sizes.where(f"n <= {BLOCK}").select("grp"), FEW), "grp", "left_semi")
    task = F.pmod(F.xxhash64("grp"), F.lit(max(1, total // (2 * BLOCK))))  # small groups share a task
    zero = F.lit(0)
    edges = compare_blocks(small.select("id", "key", "grp", zero.alias("own"), zero.alias("lo"), zero.alias("hi"), task.alias("task")), sets, percent)
    large = cut(groups.join(bounded(sizes.where(f"n > {BLOCK}"), FEW), "grp"), "shingle-large")
    if not large.limit(1).count():
        return edges
    told = among(sets, large.select(F.col("id").alias("doc_id")), "id")
    sets = sets if told is None else told.where("__in").drop("__in")  # the others aren't shuffled again
    chunk = F.pmod(F.xxhash64("key", F.lit(1)), F.ceil(F.col("n") / BLOCK)).cast("int")
    members = large.select("id", "key", "grp", F.lit(1).alias("own"), chunk.alias("chunk"))
    hubs = large.groupBy("grp", "n", F.pmod("key", F.lit(HUBS)).alias("slot")).agg(F.min(F.struct("key", "id")).alias("hub"))
    hubs = hubs.select("hub.id", "hub.key", "grp", F.lit(0).alias("own"), F.explode(F.expr(f"sequence(0, cast(ceil(n / {BLOCK}) as int) - 1)")).alias("chunk"))
    met = members.unionByName(hubs).select("id", "key", "grp", "own", zero.alias("lo"), F.lit(1).alias("hi"), F.xxhash64("grp", "chunk").alias("task"))
    first = cut(compare_blocks(met, sets, percent, hubs=True), "shingle-hub-links")
    parts = large.join(first.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("hub")).hint("merge"), "id", "left").withColumn("part", F.coalesce("hub", "id"))
    parts = cut(parts.select("id", "key", "grp", "part"), "shingle-parts")
    top = cut(parts.groupBy("grp", "part").count().groupBy("grp").agg(F.max_by("part", F.struct("count", "part")).alias("top")), "shingle-tops")
    placed = parts.join(bounded(top, FEW), "grp").withColumn("out", F.col("part") != F.col("top"))
    counts = cut(placed.groupBy("grp").agg(F.count_if("out").alias("u"), F.count_if(~F.col("out")).alias("j")).where("u > 0"), "shingle-counts")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    member = placed.join(bounded(counts, FEW), "grp").withColumns({"ub": blocks("u"), "jb": blocks("j")})
    member = member.withColumn("own", F.when(F.col("out"), F.pmod(F.xxhash64("key"), F.col("ub"))).otherwise(F.col("ub") + F.pmod(F.xxhash64("key"), F.col("jb"))).cast("int"))
    member = member.withColumn("other", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), F.col("ub") + F.col("jb") - 1)).otherwise(F.sequence(F.lit(0), F.col("ub") - 1))))
    rest = member.select("id", "key", "grp", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    rest = compare_blocks(rest.withColumn("task", F.xxhash64("grp", "lo", "hi")), sets, percent)
    return edges.unionByName(first).unionByName(rest)
