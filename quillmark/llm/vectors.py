"""Most similar vectors of every vector: lists around centroids, searched by randomly rotated one-bit codes.

Copies of a vector are one class. K = N / `list_size` lists stand on two levels: a list's centre is one of at most `most_first` centroids plus one of
ceil(K / `most_first`) residual centroids, all fitted on a bounded sample (at most FIT_ROWS vectors, by hash of the vector), so that K grows with the data and
what is sent to the tasks does not. Every class is indexed in its nearest list and asks its nearest ones, `reach` * sqrt(K) of them (or `probes`, if given).

First-level centroids are halved into blocks of about `block_rows` members; a block larger than that is divided by hash into parts, and its askers into slices
of about `slice_rows`. A cell (block, part, slice) is one task of its own, so neither a crowded region nor a much asked one is a single task. In a cell, a
member's residual to its list's centre is rotated by one random orthogonal matrix and kept as one bit a coordinate plus two correction scalars (its norm and its
product with its own code). The code gives an unbiased estimate of the inner product with an error bound; only members whose upper bound passes the asker's
k-th best so far are reranked by their real product, of 32-bit numbers. Every usable row is indexed and asks; nothing is sampled but the fitting set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.shingles import M3, mix
from quillmark.session import small, spread, written

FIT_ROWS = 65_536  # the bound of the fitting sample
EPSILON = 1.9  # of the code's error bound, in standard deviations
NEAR = np.dtype([("c", "<f4"), ("h", "<i8")])


def usable(df: DataFrame, id_col: str, group_col: str, vector_col: str, dims: dict[str, int] | None = None) -> DataFrame:
    """(id, grp, h, d, v): rows with a vector of their group's length, finite and not zero, as normalised 32-bit numbers; h names the vector. Without `dims`, a
    group's length is its most frequent one (ties: the longer). Null ids and groups take no part; a row delivered twice stays twice here."""
    d = df.select(F.col(id_col).cast("string").alias("id"), F.col(group_col).cast("string").alias("grp"), F.col(vector_col).cast("array<float>").alias("v"))
    d = spread(d.where("id is not null and grp is not null and size(v) > 0"))
    if dims is None:
        n = d.groupBy("grp", F.size("v").alias("d")).count().groupBy("grp").agg(F.max(F.struct("count", "d")).alias("m")).select("grp", F.col("m.d").alias("dim"))
    else:
        n = d.sparkSession.createDataFrame(sorted(dims.items()), "grp string, dim int")

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            col = b.column(2)
            offsets = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)
            size = np.diff(offsets)
            for k in np.unique(size):
                i = np.flatnonzero(size == k)
                x = flat[offsets[i][:, None] + np.arange(k)].astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    norm = np.sqrt((x * x).sum(axis=1))
                good = np.isfinite(norm) & (norm > 0)
                i = i[good]
                unit = (x[good] / norm[good][:, None]).astype(np.float32)
                if not len(i):
                    continue
                words = unit.view(np.uint32).astype(np.uint64)
                h = np.full(len(i), k, np.uint64)
                for c in range(int(k)):
                    h = mix(h * M3 + words[:, c])
                yield pa.RecordBatch.from_pydict({"id": b.column(0).take(pa.array(i)), "grp": b.column(1).take(pa.array(i)), "h": pa.array(h.view(np.int64)), "d": pa.array(np.full(len(i), k, np.int32)), "v": pa.array([r.tobytes() for r in unit], pa.binary())})

    return d.mapInArrow(normal, "id string, grp string, h bigint, d int, v binary").join(small(n), "grp").where("d = dim").select("id", "grp", "h", "d", "v")


def fit_centroids(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7, unit: bool = True) -> np.ndarray:
    """k means of x (fewer, if x has fewer rows); with `unit`, of length 1."""
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, False)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
        order = np.argsort(near, kind="stable")
        at = np.flatnonzero(np.diff(near[order], prepend=-1))
        total = np.add.reduceat(x[order], at)
        n = np.linalg.norm(total, axis=1) if unit else np.diff(np.r_[at, len(order)]).astype(np.float32)
        c[near[order][at]] = np.where(n[:, None] > 0, total / np.maximum(n, 1e-12)[:, None], c[near[order][at]])
    return c


class Lists:
    """Centres on two levels: list c * len(second) + r is around first[c] + second[r]."""

    def __init__(self, first: np.ndarray, second: np.ndarray):
        self.first, self.second, self.n = first, second, len(first) * len(second)
        self.half = (first * first).sum(axis=1) / 2
        self.half2 = (second * second).sum(axis=1) / 2
        self.cross = -(first @ second.T) - self.half2

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, most_first: int) -> Lists:
        first = fit_centroids(sample, min(lists, most_first))
        more = -(-lists // max(1, len(first)))
        if more == 1:
            return cls(first, np.zeros((1, sample.shape[1]), np.float32))
        rest = sample - first[np.argmax(sample @ first.T, axis=1)]
        return cls(first, fit_centroids(rest, more, unit=False))

    def centre(self, name: int) -> np.ndarray:
        return self.first[name // len(self.second)] + self.second[name % len(self.second)]

    def home(self, v: np.ndarray) -> np.ndarray:
        c = np.argmax(v @ self.first.T - self.half, axis=1)
        return c * len(self.second) + np.argmax((v - self.first[c]) @ self.second.T - self.half2, axis=1)

    def near(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The `probes` nearest lists of each vector, nearest first."""
        wide, m = min(probes, len(self.first)), len(self.second)
        out = np.empty((len(v), min(probes, self.n)), np.int64)
        step = max(1, (1 << 22) // (len(self.first) + wide * m))
        for a in range(0, len(v), step):
            x = v[a : a + step]
            s = x @ self.first.T - self.half
            c = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if wide < s.shape[1] else np.broadcast_to(np.arange(wide), (len(x), wide))
            both = (np.take_along_axis(s, c, 1)[:, :, None] + (x @ self.second.T)[:, None, :] + self.cross[c]).reshape(len(x), -1)
            name = (c[:, :, None] * m + np.arange(m)).reshape(len(x), -1)
            k = out.shape[1]
            top = np.argpartition(-both, k - 1, axis=1)[:, :k] if k < both.shape[1] else np.broadcast_to(np.arange(k), (len(x), k))
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(both, top, 1), axis=1, kind="stable"), 1)
            out[a : a + step] = np.take_along_axis(name, top, 1)
        return out


def balanced_blocks(centres: np.ndarray, members: np.ndarray, most: float) -> np.ndarray:
    """Block of each centre: the set is halved by members along its main direction until a block has at most `most` (or a single centre)."""
    out = np.zeros(len(centres), np.int64)
    todo, number = [np.arange(len(centres))], 0
    while todo:
        i = todo.pop()
        total = np.cumsum(members[i])
        if len(i) == 1 or total[-1] <= most:
            out[i] = number
            number += 1
            continue
        x = centres[i] - centres[i].mean(axis=0)
        along = x @ np.linalg.svd(x, full_matrices=False)[2][0]
        by = i[np.argsort(along, kind="stable")]
        cut = int(np.searchsorted(np.cumsum(members[by]), total[-1] / 2)) + 1
        cut = min(max(1, cut), len(i) - 1)
        todo += [by[:cut], by[cut:]]
    return out


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


class OneBitList:
    """The members of one list as one-bit codes with correction scalars."""

    def __init__(self, x: np.ndarray, centroid: np.ndarray, turn: np.ndarray):
        self.x, self.c, self.turn = x, centroid, turn
        d = x.shape[1]
        r = (x - centroid) @ turn
        norm = np.linalg.norm(r, axis=1)
        code = np.packbits(r > 0, axis=1)  # what a stored index would keep, beside two scalars a member
        own = np.maximum(np.abs(r).sum(axis=1) / (np.maximum(norm, 1e-12) * math.sqrt(d)), 1e-6)
        bound = EPSILON * np.sqrt(np.maximum(0, 1 - own**2)) / own / math.sqrt(max(1, d - 1))
        signs = (np.unpackbits(code, axis=1, count=d).astype(np.float32) * 2 - 1) / math.sqrt(d)
        # product = q.c + x.c - c.c + <turned residual of q, code> * norm / own, give or take |residual of q| * norm * bound: one matrix product
        self.table = np.concatenate([signs * (norm / own)[:, None], np.ones((len(x), 1)), (x @ centroid - centroid @ centroid)[:, None], (norm * bound)[:, None]], axis=1).astype(np.float32).T.copy()

    def query(self, q: np.ndarray) -> np.ndarray:
        r = (q - self.c) @ self.turn
        return np.concatenate([r, (q @ self.c)[:, None], np.ones((len(q), 1)), np.linalg.norm(r, axis=1)[:, None]], axis=1).astype(np.float32)

    def estimates(self, q: np.ndarray) -> np.ndarray:
        return self.query(q)[:, :-1] @ self.table[:-1]

    def upper(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the products with all members."""
        return self.query(q) @ self.table


def search(lists: list[OneBitList], ids: list[np.ndarray], q: np.ndarray, qid: np.ndarray, order: np.ndarray, k: int, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Of each query the k best members (id, product) of the lists it asks, nearest list first; -1 where there are fewer. order: for each query the numbers of
    its lists, -1 where it asks none."""
    best = np.full((len(q), k), -2.0, np.float32)
    who = np.full((len(q), k), -1, np.int64)
    for step in range(order.shape[1]):
        by_list = np.argsort(order[:, step], kind="stable")
        cuts = np.searchsorted(order[by_list, step], np.arange(len(lists) + 1))
        for j in range(len(lists)):
            one, name_of, asking = lists[j], ids[j], by_list[cuts[j] : cuts[j + 1]]
            for z in range(0, len(asking), chunk):
                at = asking[z : z + chunk]
                qs = q[at]
                up = one.upper(qs)
                floor = best[at, k - 1].copy()
                fresh = np.flatnonzero(floor < -1)
                n = up.shape[1]
                if len(fresh) and n > 2 * k:  # a first floor from the best estimates
                    est = up[fresh] if step == 0 else one.estimates(qs[fresh])
                    first = np.argpartition(-est, k, axis=1)[:, : k + 1]
                    exact = np.einsum("ikd,id->ik", one.x[first], qs[fresh])
                    exact[name_of[first] == qid[at[fresh]][:, None]] = -2
                    floor[fresh] = np.sort(exact, axis=1)[:, -k] - 1e-6
                passes = up > floor[:, None]
                share = np.count_nonzero(passes)
                if not share:
                    continue
                if share > 0.005 * up.size:  # one matrix product costs less than so many gathers
                    whole = qs @ one.x.T
                    passes &= whole > floor[:, None]
                    i, m = np.divmod(np.flatnonzero(passes), n)
                    exact = whole[i, m]
                else:
                    i, m = np.nonzero(passes)
                    exact = np.einsum("nd,nd->n", one.x[m], qs[i])
                good = (exact > floor[i]) & (name_of[m] != qid[at[i]])
                i, m, exact = i[good], m[good], exact[good]
                if not len(i):
                    continue
                count = np.bincount(i, minlength=len(at))
                place = np.arange(len(i)) - (np.cumsum(count) - count)[i]
                for few in (True, False):  # rows with few new ones, then those with many
                    rows = np.flatnonzero((count > 0) & ((count <= 16) == few))
                    if not len(rows):
                        continue
                    mine = (count[i] <= 16) == few
                    local = np.searchsorted(rows, i[mine])
                    score = np.full((len(rows), k + int(count[rows].max())), -2, np.float32)
                    name = np.full(score.shape, -1, np.int64)
                    score[:, :k], name[:, :k] = best[at[rows]], who[at[rows]]
                    score[local, k + place[mine]], name[local, k + place[mine]] = exact[mine], name_of[m[mine]]
                    top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                    best[at[rows]], who[at[rows]] = np.take_along_axis(score, top, 1), np.take_along_axis(name, top, 1)
    return who, best


def _vectors_of(b: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    col = b.column(column)
    at = int(np.frombuffer(col.buffers()[1], np.int32)[col.offset])
    return np.frombuffer(col.buffers()[2], np.float32, count=len(col) * dim, offset=at).reshape(-1, dim)


def _of_group(classes: DataFrame, k: int, n: int, dim: int, list_size: int, probes: int | None, reach: float, block_rows: int, slice_rows: int, most_first: int) -> DataFrame:
    """classes (h, v) of one group, in any number of copies -> (h, nh, cosine)."""
    spark = classes.sparkSession
    lists = max(1, round(n / list_size))
    want = min(FIT_ROWS, max(2_000, 64 * lists))
    part = classes if n <= want else classes.where(F.pmod(F.xxhash64("h"), F.lit(1_000_003)) < int(1_000_003 * 1.2 * want / n))
    rows = part.dropDuplicates(["h"]).select("v").limit(want).collect()  # bounded by FIT_ROWS
    sample = np.frombuffer(b"".join(bytes(r.v) for r in rows), np.float32).reshape(-1, dim)
    index = Lists.fit(sample, lists, most_first)
    probes = max(1, min(index.n, probes or math.ceil(reach * math.sqrt(index.n))))
    per = len(index.second)
    share = n / len(sample)
    first_of = index.home(sample) // per
    block_of = balanced_blocks(index.first, np.bincount(first_of, minlength=len(index.first)) * share, block_rows)
    blocks = int(block_of.max()) + 1
    asked = block_of[index.near(sample, probes) // per]
    # expected members and askers of each block; they only say into how many cells it is divided
    members = np.bincount(block_of[first_of], minlength=blocks) * share
    askers = np.array([(asked == b).any(axis=1).sum() for b in range(blocks)]) * share
    parts = np.maximum(1, np.ceil(members / (1.5 * block_rows))).astype(np.int64)
    slices = np.maximum(1, np.ceil(askers / slice_rows)).astype(np.int64)
    first_cell = np.cumsum(parts * slices) - parts * slices
    shared = spark.sparkContext.broadcast((index, block_of, rotation(dim)))  # at most `most_first` centroids on the first level, sqrt-like few on the second

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, block_of, _ = shared.value
        seen: set[int] = set()  # vectors this task has sent already: a hot group of copies is sent about once a task
        for b in batches:
            if not b.num_rows:
                continue
            if len(seen) > 500_000:
                seen.clear()
            h, once = np.unique(b.column(0).to_numpy(), return_index=True)
            new = np.array([x not in seen for x in h.tolist()], bool)
            h, once = h[new], once[new]
            seen.update(h.tolist())
            if not len(h):
                continue
            v = _vectors_of(b, 1, dim)[once]
            u = mix(h.view(np.uint64))
            home = block_of[index.home(v) // per]
            own_part = ((u >> np.uint64(32)) % parts[home].astype(np.uint64)).astype(np.int64)
            asked = block_of[index.near(v, probes) // per]
            out = []  # (row, cell, kind): 0 member and asker, 1 member, 2 asker
            for blk in np.unique(np.r_[home, asked.ravel()]):
                mine = (u % np.uint64(slices[blk])).astype(np.int64)
                is_home, asks = home == blk, (asked == blk).any(axis=1)
                for s in range(parts[blk]):
                    for t in range(slices[blk]):
                        member, asker = is_home & (own_part == s), asks & (mine == t)
                        i = np.flatnonzero(member | asker)
                        out.append((i, np.full(len(i), first_cell[blk] + s * slices[blk] + t), np.where(member[i] & asker[i], 0, np.where(member[i], 1, 2))))
            i = np.concatenate([x[0] for x in out])
            raw = np.ascontiguousarray(v).tobytes()
            size = 4 * dim
            yield pa.RecordBatch.from_pydict({
                "cell": pa.array(np.concatenate([x[1] for x in out]).astype(np.int32)), "kind": pa.array(np.concatenate([x[2] for x in out]).astype(np.int8)),
                "h": pa.array(h[i]), "v": pa.array([raw[a * size : a * size + size] for a in i.tolist()], pa.binary()),
            })

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, _, turn = shared.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def answer() -> Iterator[pa.RecordBatch]:
            kind, h, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            m, a = np.flatnonzero(kind < 2), np.flatnonzero(kind != 1)
            m, a = m[np.unique(h[m], return_index=True)[1]], a[np.unique(h[a], return_index=True)[1]]
            if not len(m) or not len(a):
                return
            home = index.home(v[m])
            by = np.argsort(home, kind="stable")
            names, at = np.unique(home[by], return_index=True)
            groups = np.split(m[by], at[1:])
            codes = [OneBitList(v[g], index.centre(int(x)), turn) for x, g in zip(names, groups)]
            near = index.near(v[a], probes)
            order = np.minimum(np.searchsorted(names, near), len(names) - 1)
            order = np.where(names[order] == near, order, -1)
            order = np.take_along_axis(order, np.argsort(order < 0, axis=1, kind="stable"), 1)[:, : len(names)]
            who, best = search(codes, [h[g] for g in groups], v[a], h[a], order, k)
            packed = np.zeros((len(a), k), NEAR)
            packed["c"], packed["h"] = best, who
            some = np.flatnonzero(best[:, 0] > -2)
            for z in range(0, len(some), 10_000):
                c = some[z : z + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array(h[a[c]]), pa.array([packed[r, : np.count_nonzero(best[r] > -2)].tobytes() for r in c], pa.binary())], ["h", "near"])

        now = -1
        for b in batches:
            if not b.num_rows:
                continue
            cell, kind, h = (b.column(c).to_numpy() for c in range(3))
            v = _vectors_of(b, 3, dim)
            for i in np.split(np.arange(len(h)), np.flatnonzero(np.diff(cell)) + 1):
                if cell[i[0]] != now and held:
                    yield from answer()
                now = cell[i[0]]
                held.append((kind[i], h[i], v[i]))
        if held:
            yield from answer()

    moved = classes.select("h", "v").mapInArrow(send, "cell int, kind tinyint, h bigint, v binary")
    met = moved.repartitionById(int((parts * slices).sum()), "cell").mapInArrow(walk, "h bigint, near binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in range(0, b.num_rows, 2_000):
                c = b.slice(z, 2_000)
                found = [np.frombuffer(b"".join(x), NEAR) for x in c.column(1).to_pylist()]
                row = np.repeat(np.arange(len(found)), [len(x) for x in found])
                every = np.concatenate(found)
                by = np.lexsort((every["h"], -every["c"], row))
                row, every = row[by], every[by]
                again = (np.diff(row, prepend=-1) == 0) & (np.diff(every["h"], prepend=every["h"][:1]) == 0)
                again[:1] = False
                row, every = row[~again], every[~again]
                keep = np.arange(len(row)) - np.searchsorted(row, np.arange(len(found)))[row] < k
                row, every = row[keep], every[keep]
                yield pa.RecordBatch.from_pydict({"h": pa.array(c.column(0).to_numpy()[row]), "nh": pa.array(np.ascontiguousarray(every["h"])), "cosine": pa.array(np.ascontiguousarray(every["c"]))})

    # at most one entry a cell that a vector asks
    return met.groupBy("h").agg(F.collect_list("near").alias("near")).mapInArrow(merge, "h bigint, nh bigint, cosine float")


def nearest(df: DataFrame, id_col: str, group_col: str, vector_col: str, k: int = 10, min_cosine: float | None = None, list_size: int = 700, probes: int | None = None, reach: float = 1.8, block_rows: int = 32_000, slice_rows: int = 24_000, most_first: int = 4_096, dims: dict[str, int] | None = None, groups: list[str] | None = None) -> DataFrame:
    """(grp, id, neighbour, cosine, rank): the k most similar other ids of the same group, ranks 1..k; ties in the order of the neighbour's id. With
    `min_cosine`, only neighbours at least so similar.

    Null, empty, zero, NaN and infinite vectors and those of another length than their group's take no part; repeated rows count once; a group with a
    single usable id has no rows; extra columns are ignored. `groups` names the groups to search (all by default; they are few and of any size).
    """
    rows = usable(df, id_col, group_col, vector_col, dims)
    rows = written(rows if groups is None else rows.where(F.col("grp").isin(groups)))
    # of several vectors of one id, one is kept
    all_ = written(rows.groupBy("grp", "id").agg(F.min("h").alias("h"), F.max("d").alias("d")))
    known = [(r.grp, r.n, r.d) for r in all_.groupBy("grp").agg(F.count("*").alias("n"), F.max("d").alias("d")).orderBy("grp").collect()]  # a row a collection
    links = None
    for grp, n, dim in known:
        one = _of_group(rows.where(F.col("grp") == grp).select("h", "v"), k, n, dim, list_size, probes, reach, block_rows, slice_rows, most_first).withColumn("grp", F.lit(grp))
        links = one if links is None else links.unionByName(one)
    if links is None:
        return all_.select("grp", "id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).limit(0)
    links = links.select("grp", "h", "nh", F.col("cosine").cast("double").alias("cosine"))
    if min_cosine is not None:  # of the whole neighbourhoods
        links = written(links.where(F.col("cosine") >= min_cosine))
    in_class = Window.partitionBy("grp", "h").orderBy("id")
    firsts = all_.select("grp", "h", "id").withColumn("r", F.row_number().over(in_class)).where(F.col("r") <= k + 1)
    copies = all_.groupBy("grp", "h").count().where("count > 1").select("grp", "h", F.col("h").alias("nh"), F.lit(1.0).alias("cosine"))
    links = links.unionByName(copies)
    named = links.join(firsts.select("grp", F.col("h").alias("nh"), F.col("id").alias("neighbour")), ["grp", "nh"])
    short = named.withColumn("r", F.row_number().over(Window.partitionBy("grp", "h").orderBy(F.desc("cosine"), "neighbour"))).where(F.col("r") <= k + 1)
    out = all_.select("grp", "h", "id").join(short.select("grp", "h", "neighbour", "cosine"), ["grp", "h"]).where("id != neighbour")
    rank = F.row_number().over(Window.partitionBy("grp", "id").orderBy(F.desc("cosine"), "neighbour"))
    return out.select("grp", "id", "neighbour", "cosine", rank.alias("rank")).where(F.col("rank") <= k)


def mutual(links: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs in which each is among the other's neighbours."""
    links = written(links.select("grp", "id", "neighbour"))
    back = links.select("grp", F.col("neighbour").alias("id"), F.col("id").alias("neighbour"))
    return links.where("id < neighbour").join(back, ["grp", "id", "neighbour"], "left_semi").select(F.col("id").alias("id_a"), F.col("neighbour").alias("id_b")).distinct()
