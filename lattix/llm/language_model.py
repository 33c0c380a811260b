"""Scoring by a gated recurrent language model with a class-factored softmax, in numpy.

Corpus counts cover every training document: texts are gathered in chunks, a chunk's distinct words with their training
counts go, packed, to buckets by word hash, buckets add them up and answer each chunk with the counts of its own words.
So no task and not the driver ever holds the corpus's vocabulary, and frequent words are one entry per chunk. A chunk keeps
its distinct words once and its texts as their numbers, so that texts are split and looked up once, not at every use.

The most frequent tokens are the model's own, as many as the root of the number of types (times ``GROWTH``) and at least
``VOCABULARY``; any other is one more class, out of which a token is drawn in proportion to its count plus one. A GRU is
trained with truncated backpropagation through time on every training document from its first to its last token, with
words in frequency classes: in each round, learners go through their share of the stored texts, each from the same weights,
and their weights are averaged. Learners and what each reads grow with the root of the input, and no text is read by two.
Scoring runs many documents side by side and carries each one's state across windows, to the end of the whole text. Counts
don't depend on how rows are dealt out; the weights, and so ``score``, do.

Defined cases. Null or empty text: only the end token. A null id: a training document, held_out false. No training
document at all: N and V are 0, counts are 0, and the model is its prior. Repeated rows each count and get their row. Very
long texts are scored and learned from to their end; a window of their ids is held at a time. Ties: of equally frequent tokens
the least bytes come first. Empty table: no rows. Other columns are not read; the id's column must not be called like a
result's.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored, text_bytes
from .words import LOWER, hash_slices, pieces

VOCABULARY = 1000
GROWTH = 1
HIDDEN = 16
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
LANES = 512
LEARNER_BYTES = 1 << 20  # an input of n times that has root n learners
ROUNDS = 4
ROUND_TOKENS = 100_000  # of a learner, at least, for more than one round
PIECE = 4096  # numbers of one parameter that are averaged together
LEAST_STEPS = 400  # of training: a small corpus is gone through more often
WINDOW = 32
ROWS = 2048
END = b" "  # no word is a blank
TAME = 40.0  # exponentials of so much can be added up in single precision


def held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string")) % 7 == 2, F.lit(False))


def split(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def own_words(types: float) -> int:
    """Tokens that the model has as its own, for so many types of the corpus."""
    return max(VOCABULARY, int(GROWTH * math.sqrt(types)))


# ---------------------------------------------------------------- counts


def chunks(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """Rows of two kinds: bucket null, a chunk's ids, its distinct words by bucket, its texts as numbers of these, and their lengths;
    bucket b, the chunk's distinct words of that bucket with training counts."""
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("out", T.ArrayType(T.BooleanType())), T.StructField("packed", T.BinaryType()), T.StructField("counts", T.BinaryType()), T.StructField("numbers", T.BinaryType())])
    source = docs.select(F.col(f"`{doc_id}`").alias("id"), held_out(doc_id).alias("out"), F.col(f"`{text}`").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 33
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for part, texts in pieces(batch, "text", CHUNK_BYTES):
                out = part.column(1).to_pylist()
                place: defaultdict[bytes, int] = defaultdict()
                place.default_factory = place.__len__  # a new word gets the next number
                end, number = place[END], place.__getitem__
                texts = [[*map(number, split(t)), end] for t in texts]
                lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
                flat = np.fromiter(chain.from_iterable(texts), dtype=np.int32, count=int(lengths.sum()))
                words = list(place)
                size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                h = hash_slices(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(size) - size, size)
                of = (h >> np.uint64(20)) % np.uint64(buckets)
                order = np.argsort(of, kind="stable")
                cut = np.searchsorted(of[order], np.arange(buckets + 1, dtype=np.uint64))
                count = np.bincount(flat[np.repeat(~np.array(out, dtype=bool), lengths)], minlength=len(words))
                rank = np.empty(len(words), dtype=np.int32)
                rank[order] = np.arange(len(words), dtype=np.int32)
                packed = [pack(b"\n".join(words[i] for i in order[a:b].tolist())) for a, b in zip(cut[:-1], cut[1:]) if b > a]
                counts = [pack(count[order[a:b]].tobytes()) for a, b in zip(cut[:-1], cut[1:]) if b > a]
                n = len(packed)
                rows = [
                    pa.array([chunk] * (n + 1), pa.int64()),
                    pa.array([None, *np.flatnonzero(np.diff(cut)).tolist()], pa.int32()),
                    pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), part.column(0)), pa.nulls(n, pa.list_(part.column(0).type))]),
                    pa.array([out, *[None] * n], pa.list_(pa.bool_())),
                    pa.array([pack(b"\n".join(words[i] for i in order.tolist())), *packed], pa.binary()),
                    pa.array([pack(lengths.tobytes()), *counts], pa.binary()),
                    pa.array([pack(_planes(rank[flat])), *[None] * n], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(rows, names=schema.names)
                chunk += 1

    return source.mapInArrow(scan, schema)


def _planes(x: np.ndarray) -> bytes:
    """Numbers by their first bytes, then their second ones and so on, which packs better."""
    return np.ascontiguousarray(x.astype(np.int32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()


def answers(requests: DataFrame, vocabulary: int | None, buckets: int) -> DataFrame:
    """One row per request with the corpus counts of its words, in their order; one row per bucket with its totals and most frequent words.

    A bucket gives ``vocabulary`` words, or its share of the model's own by the number of its types, 12 deviations and some more.
    """
    schema = "chunk long, bucket int, counts binary, tokens long, types long, top array<struct<word:binary,n:long>>"

    def merge(group: pa.Table) -> pa.Table:
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        total: dict[bytes, int] = {}
        asked = []
        for packed, counts in zip(group.column("packed").to_pylist(), group.column("counts").to_pylist()):
            words = unpack(packed).split(b"\n")
            asked.append(words)
            for x, n in zip(words, np.frombuffer(unpack(counts), dtype=np.int64).tolist()):
                total[x] = total.get(x, 0) + n
        k = len(asked)
        types = sum(n > 0 for n in total.values())
        share = 1.25 * own_words(types * buckets) / buckets
        most = vocabulary or max(VOCABULARY, int(share + 12 * math.sqrt(share)))
        top = sorted(((x, n) for x, n in total.items() if n), key=lambda p: (-p[1], p[0]))[:most] if len(total) < most else _most(total, most)
        return pa.table({
            "chunk": pa.concat_arrays([group.column("chunk").combine_chunks(), pa.array([None], pa.int64())]),
            "bucket": pa.array([group.column("bucket")[0].as_py()] * (k + 1), pa.int32()),
            "counts": pa.array([*(pack(np.array([total[x] for x in words], dtype=np.int64).tobytes()) for words in asked), None], pa.binary()),
            "tokens": pa.array([*[None] * k, sum(total.values())], pa.int64()),
            "types": pa.array([*[None] * k, types], pa.int64()),
            "top": pa.array([*[None] * k, [{"word": x, "n": n} for x, n in top]], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))),
        })

    return requests.groupBy("bucket").applyInArrow(merge, schema)


def _most(total: dict[bytes, int], k: int) -> list[tuple[bytes, int]]:
    n = np.fromiter(total.values(), dtype=np.int64, count=len(total))
    least = max(1, int(np.partition(n, -k)[-k]))
    return sorted(((x, c) for x, c in total.items() if c >= least), key=lambda p: (-p[1], p[0]))[:k]


# ---------------------------------------------------------------- model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place; a sigmoid is a tanh of half the argument."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _exp(x: np.ndarray, tame: bool = False) -> tuple[np.ndarray | float, np.ndarray]:
    """In place, of each row less its largest value, or of tame rows as they are; what went off, and the rows' sums."""
    most = 0.0
    if not tame:
        most = x.max(axis=1, keepdims=True)
        x -= most
        most = most[:, 0]
    np.exp(x, out=x)
    return most, x @ np.ones(x.shape[1], dtype=x.dtype)


def _softmax(x: np.ndarray, tame: bool = False) -> np.ndarray:
    x /= _exp(x, tame)[1][:, None]
    return x


def _sorted(x: np.ndarray, most: int) -> np.ndarray:
    """Stable order of numbers under most; short ones are sorted by their digits."""
    return np.argsort(x.astype(np.uint16) if most <= 1 << 16 else x, kind="stable")


def _log_chosen(x: np.ndarray, column: np.ndarray, tame: bool = False) -> np.ndarray:
    """Log of the softmax of each row in one of its columns; x is used up."""
    own = x[np.arange(len(x)), column]
    most, total = _exp(x, tame)
    return own - most - np.log(total)


@dataclass
class Model:
    words: dict[bytes, int]  # token -> id; the last id is any other token
    members: list[np.ndarray]  # ids by class
    class_of: np.ndarray
    place: np.ndarray  # of an id in its class
    p: dict[str, np.ndarray]
    tokens: int
    types: int
    rest: float  # what the other tokens' counts plus one add up to

    @property
    def other(self) -> int:
        return len(self.words)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        of, other = self.words.get, self.other
        return np.fromiter((of(x, other) for x in words), dtype=np.int64, count=len(words))

    @property
    def tame(self) -> bool:
        """Whether no logit can be too great or small for its exponential as it is; a state is within 1."""
        most = (np.abs(self.p[w]).sum(axis=axis).max() + np.abs(self.p[b]).max() for w, b, axis in (("Wc", "bc", 0), ("Wo", "bo", 1)))
        return all(x < TAME for x in most)

    def step(self, gates: np.ndarray, h: np.ndarray) -> np.ndarray:
        k = h.shape[1]
        u = h @ self.p["U"]
        zr = _sigmoid(gates[:, : 2 * k] + u[:, : 2 * k])
        n = np.tanh(gates[:, 2 * k :] + zr[:, k:] * u[:, 2 * k :])
        return n + zr[:, :k] * (h - n)

    def log_p(self, h: np.ndarray, y: np.ndarray, tame: bool = False) -> np.ndarray:
        """Natural log of P(y | h), by row."""
        c = self.class_of[y]
        out = np.concatenate([_log_chosen(h[r : r + ROWS] @ self.p["Wc"] + self.p["bc"], c[r : r + ROWS], tame) for r in range(0, len(y), ROWS)]) if len(y) else np.zeros(0)
        order = _sorted(c, len(self.members))
        cut = np.searchsorted(c[order], np.arange(len(self.members) + 1))
        by_class, place, inside = h[order], self.place[y[order]], np.zeros(len(y))
        for k, ids in enumerate(self.members):
            a, b = cut[k], cut[k + 1]
            if b > a and len(ids) > 1:
                of = slice(ids[0], ids[-1] + 1)  # a class is a run of ids
                inside[a:b] = _log_chosen(by_class[a:b] @ self.p["Wo"][of].T + self.p["bo"][of], place[a:b], tame)
        out[order] += inside
        return out

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-likelihood of each text's ids, which end with the end token; its state starts at 0 after an end token."""
        total = np.zeros(len(texts))
        if not texts:
            return total
        table, tame = self.p["E"] @ self.p["Wx"] + self.p["b"], self.tame
        sizes = np.array([len(t) for t in texts])
        flat = np.concatenate(texts)
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        start = self.words.get(END, self.other)
        for a in range(0, len(order), LANES):
            lanes = order[a : a + LANES]
            length, at = sizes[lanes], begin[lanes]
            h = np.zeros((len(lanes), HIDDEN), dtype=np.float32)
            before = np.full(len(lanes), start)
            for s in range(0, length[0], WINDOW):
                live = int(np.searchsorted(-length, -s, "left"))  # lanes are by length, longest first
                step = np.arange(s, min(s + WINDOW, length[0]))[:, None]
                inside = step < length[None, :live]
                y = np.where(inside, flat[np.minimum(at[:live] + step, len(flat) - 1)], start)  # of one window, however long the texts
                h, states = h[:live], []
                x = np.concatenate([before[None, :live], y[:-1]])
                for t in range(len(y)):
                    states.append(h := self.step(table[x[t]], h))
                before = y[-1]
                inside = inside.ravel()
                got = np.zeros(len(inside))
                got[inside] = self.log_p(np.concatenate(states)[inside], y.ravel()[inside], tame)
                total[lanes[:live]] += got.reshape(y.shape).sum(axis=0)
        return total


def new_model(top: list[tuple[bytes, int]], tokens: int, types: int, seed: int = 7) -> Model:
    rest = float(tokens + types + 1 - sum(n + 1 for _, n in top))
    mass = np.array([n + 1.0 for _, n in top] + [max(rest, 1.0)])
    root = np.sqrt(mass[:-1])
    classes = max(24, int(0.75 * math.sqrt(len(root))))
    class_of = np.minimum((np.cumsum(root) - root) / max(root.sum(), 1) * (classes - 1), classes - 2).astype(int) if len(root) else np.zeros(0, dtype=int)
    used = np.unique(class_of)
    class_of = np.append(np.searchsorted(used, class_of), len(used))
    members = [np.flatnonzero(class_of == k) for k in range(len(used) + 1)]
    place = np.concatenate([np.arange(len(m)) for m in members])
    r, m, k = np.random.default_rng(seed), len(mass), len(members)
    f = lambda *s: (r.standard_normal(s) * 0.1).astype(np.float32)
    p = {"E": f(m, HIDDEN), "Wx": f(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, dtype=np.float32), "U": f(HIDDEN, 3 * HIDDEN), "Wc": f(HIDDEN, k) * 0, "bc": np.log([mass[x].sum() for x in members]).astype(np.float32), "Wo": f(m, HIDDEN) * 0, "bo": np.log(mass).astype(np.float32)}
    return Model({x: i for i, (x, _) in enumerate(top)}, members, class_of, place, p, tokens, types, rest)


def train(model: Model, texts: list[np.ndarray], epochs: int | None = None, lanes: int = 32, rate: float = 3e-3) -> None:
    """Truncated backpropagation through time: windows of WINDOW tokens, the state carried on without its gradient. Adam."""
    start = model.words.get(END, model.other)
    stream = np.concatenate([np.zeros(0, dtype=np.int64), *texts])
    if not len(stream):
        return
    n = max(2, -(-len(stream) // lanes))
    ids = np.resize(stream, lanes * n).reshape(lanes, n).T  # the last lane is filled up from the first
    epochs = epochs or max(1, -(-LEAST_STEPS * WINDOW // n))
    p, k = model.p, HIDDEN
    m1, m2, turn = {x: np.zeros_like(v) for x, v in p.items()}, {x: np.zeros_like(v) for x, v in p.items()}, 0

    def adam(name: str, v: np.ndarray) -> None:
        v = np.clip(v * np.float32(1 / lanes), np.float32(-5), np.float32(5))
        a, b = m1[name], m2[name]
        a += np.float32(0.1) * (v - a)
        b += np.float32(0.001) * (v * v - b)
        p[name] -= np.float32(rate / (1 - 0.9**turn)) * a / (np.sqrt(b * np.float32(1 / (1 - 0.999**turn))) + np.float32(1e-8))

    for _ in range(epochs):
        h = np.zeros((lanes, k), dtype=np.float32)
        before = np.full(lanes, start)
        for s in range(0, n, WINDOW):
            turn += 1
            y = ids[s : s + WINDOW]
            x = np.concatenate([before[None], y[:-1]])
            before = y[-1]
            fresh = x == start  # a new text begins: the state is 0
            keep, states, gates = [], [], []
            times = np.bincount(x.ravel())
            met = np.flatnonzero(times)
            at = (np.cumsum(times > 0) - 1)[x]
            table = p["E"][met] @ p["Wx"] + p["b"]
            for t in range(len(y)):
                h = np.where(fresh[t][:, None], np.float32(0), h)
                a = table[at[t]]
                u = h @ p["U"]
                zr = _sigmoid(a[:, : 2 * k] + u[:, : 2 * k])
                z, r = zr[:, :k], zr[:, k:]
                c = np.tanh(a[:, 2 * k :] + r * u[:, 2 * k :])
                keep.append((h, u, z, r, c))
                h = c + z * (h - c)
                states.append(h)
            out, flat, tame = np.concatenate(states), y.ravel(), model.tame
            cls = model.class_of[flat]
            dh_out, by_class, by_bias = np.empty_like(out), np.zeros_like(p["Wc"]), np.zeros_like(p["bc"])
            for r in range(0, len(flat), ROWS):  # blocks that stay in the processor's cache
                some = out[r : r + ROWS]
                d = _softmax(some @ p["Wc"] + p["bc"], tame)
                d[np.arange(len(some)), cls[r : r + ROWS]] -= 1
                dh_out[r : r + ROWS] = d @ p["Wc"].T
                by_class += some.T @ d
                by_bias += d.sum(axis=0)
            adam("Wc", by_class)
            adam("bc", by_bias)
            order = _sorted(cls, len(model.members))
            cut = np.searchsorted(cls[order], np.arange(len(model.members) + 1))
            by_cls, place, back = out[order], model.place[flat[order]], np.zeros_like(out)
            by_token, token_bias = np.zeros_like(p["Wo"]), np.zeros_like(p["bo"])
            for j, member in enumerate(model.members):
                a, b = cut[j], cut[j + 1]
                if len(member) > 1 and b > a:
                    of, some = slice(member[0], member[-1] + 1), by_cls[a:b]  # a class is a run of ids
                    d = _softmax(some @ p["Wo"][of].T + p["bo"][of], tame)
                    d[np.arange(b - a), place[a:b]] -= 1
                    np.matmul(d, p["Wo"][of], out=back[a:b])
                    np.matmul(d.T, some, out=by_token[of])
                    d.sum(axis=0, out=token_bias[of])
            dh_out[order] += back
            adam("Wo", by_token)
            adam("bo", token_bias)
            dh = np.zeros((lanes, k), dtype=np.float32)
            hidden = []
            for t in range(len(y) - 1, -1, -1):
                hp, u, z, r, c = keep[t]
                dh = dh + dh_out[t * lanes : (t + 1) * lanes]
                dz, dc = dh * (hp - c) * z * (1 - z), dh * (1 - z) * (1 - c * c)
                dr = dc * u[:, 2 * k :] * r * (1 - r)
                gates.append(np.concatenate([dz, dr, dc], axis=1))
                du = np.concatenate([dz, dr, dc * r], axis=1)
                hidden.append(du)
                dh = np.where(fresh[t][:, None], np.float32(0), dh * z + du @ p["U"].T)
            da, du = np.concatenate(gates[::-1]), np.concatenate(hidden[::-1])
            order = _sorted(at.ravel(), len(met))
            by_word = np.add.reduceat(da[order], np.searchsorted(at.ravel()[order], np.arange(len(met))))
            emb, grad = p["E"][met], np.zeros_like(p["E"])
            grad[met] = by_word @ p["Wx"].T
            adam("U", np.concatenate([x[0] for x in keep]).T @ du)
            adam("Wx", emb.T @ by_word)
            adam("b", da.sum(axis=0))
            adam("E", grad)


def learned(texts: DataFrame, model: Model, learners: int, rounds: int) -> int:
    """Trains on all training documents of the rows (packed, counts, numbers, out); the number of tokens gone through, each counted once.

    A learner's weights count by its tokens, the vector of a token by how often the learner met it.
    """
    spark = texts.sparkSession
    trained = 0
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turn: int = turn) -> Iterator[pa.RecordBatch]:
            own, unpack = shared.value, zstandard.ZstdDecompressor().decompress
            own = replace(own, p={k: v.copy() for k, v in own.p.items()})
            other, ids = own.other, []
            for batch in batches:
                for packed, counts, numbers, out in zip(*batch.columns):
                    at, flat, end = own.numbers(unpack(packed.as_py()).split(b"\n")).astype(np.int32), _from_planes(unpack(numbers.as_py())), np.cumsum(np.frombuffer(unpack(counts.as_py()), dtype=np.int64))
                    begin = np.r_[0, end]
                    ids += [at[flat[begin[i] : end[i]]] for i, o in enumerate(out.as_py()) if not o and i % rounds == turn]
            n = sum(map(len, ids))
            if not n:
                return
            lanes = int(np.clip(n // (100 * WINDOW), 32, 512))
            train(own, ids, max(1, -(-LEAST_STEPS * WINDOW * lanes // (rounds * n))), lanes)
            times = np.bincount(np.concatenate(ids), minlength=other + 1)
            sums = {k: (v * times[:, None] if k == "E" else v * float(n)).astype(np.float64).ravel() for k, v in own.p.items()}
            sums |= {"times": times.astype(np.float64), "n": np.array([n], dtype=np.float64)}
            who = TaskContext.get().partitionId()
            for name, v in sums.items():
                at = range(0, len(v), PIECE)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(list(at), pa.int64()), pa.array([who] * len(at), pa.int32()), pa.array([v[a : a + PIECE].tobytes() for a in at], pa.binary())], names=["name", "at", "who", "sums"])

        def add(group: pa.Table) -> pa.Table:
            group = group.sort_by("who")
            total = sum(np.frombuffer(x, dtype=np.float64) for x in group.column("sums").to_pylist())
            return pa.table({"name": group.column("name").slice(0, 1), "at": group.column("at").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

        made = texts.select("packed", "counts", "numbers", "out").coalesce(learners).mapInArrow(learn, "name string, at long, who int, sums binary")
        rows = sorted(made.groupBy("name", "at").applyInArrow(add, "name string, at long, sums binary").collect(), key=lambda r: r["at"])
        shared.destroy()
        sums = {k: np.concatenate([np.frombuffer(r["sums"], dtype=np.float64) for r in rows if r["name"] == k]) for k in {r["name"] for r in rows}}
        if not sums:
            continue
        n, times = sums["n"][0], sums["times"][:, None]
        trained += int(n)
        for k, v in model.p.items():
            x = sums[k].reshape(v.shape)
            model.p[k] = (np.where(times > 0, x / np.maximum(times, 1), v) if k == "E" else x / n).astype(np.float32)
    return trained


# ---------------------------------------------------------------- operator


def score_documents(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    spark = docs.sparkSession
    size = text_bytes(docs, text)
    buckets = max(4, -(-size // BUCKET_BYTES))
    gathered = stored(chunks(docs, doc_id, text, buckets))
    answered = stored(answers(gathered.filter("bucket is not null").select("chunk", "bucket", "packed", "counts"), vocabulary, buckets))
    sums = answered.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    tokens, types = sums["n"] or 0, sums["v"] or 0
    top = answered.filter("tokens is not null").select(F.explode("top").alias("t")).orderBy(F.col("t.n").desc(), "t.word").limit(vocabulary or own_words(types)).collect()
    model = new_model([(bytes(r["t"]["word"]), r["t"]["n"]) for r in top], tokens, types)
    if tokens:
        learners = max(1, math.isqrt(size // LEARNER_BYTES))
        learned(gathered.filter("bucket is null"), model, learners, min(ROUNDS, max(1, tokens // (learners * ROUND_TOKENS))))
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), *(T.StructField(n, t) for n, t in (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())))])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        model, unpack = shared.value, zstandard.ZstdDecompressor().decompress
        counts = dict(zip(right.column("bucket").to_pylist(), right.column("counts").to_pylist()))
        count = np.concatenate([np.frombuffer(unpack(counts[b]), dtype=np.int64) for b in sorted(counts)])
        base = np.log10((count + 1) / (model.tokens + model.types + 1))
        own = model.numbers(unpack(left.column("packed")[0].as_py()).split(b"\n"))
        # a token outside the model's own: its share of the other tokens' mass
        inner = np.where(own == model.other, np.log((count + 1) / max(model.rest, 1.0)), 0.0)
        ids, out = left.column("ids")[0].values, left.column("out")[0].as_py()
        end = np.cumsum(np.frombuffer(unpack(left.column("counts")[0].as_py()), dtype=np.int64))
        texts = np.split(_from_planes(unpack(left.column("numbers")[0].as_py())), end[:-1])
        score = model.score([own[t] for t in texts]) + [inner[t].sum() for t in texts]
        return pa.table([
            ids, pa.array(out, pa.bool_()), pa.array([len(t) for t in texts], pa.int64()), pa.array([int((count[t] > 0).sum()) for t in texts], pa.int64()),
            pa.array([model.tokens] * len(texts), pa.int64()), pa.array([float(base[t].sum()) for t in texts]), pa.array(score / math.log(10)),
        ], names=schema.names)

    return gathered.filter("bucket is null").groupBy("chunk").cogroup(answered.filter("chunk is not null").select("chunk", "bucket", "counts").groupBy("chunk")).applyInArrow(finish, schema)
