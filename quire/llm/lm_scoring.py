"""Hierarchical Pitman-Yor language model, sampled and scored as Spark jobs.

The context of a token is the word before it.  Each context has a restaurant whose dishes are words and
whose customers are its training tokens.  All share one parent: its customers are their tables, its
base is uniform over the vocabulary and one unknown word.  Gibbs sweeps take customers out and seat
them again, discounts and strengths are sampled between sweeps, and the predictive probabilities of
several sweeps are averaged.

Texts lie in blocks of some megabytes.  A block sends its distinct (context, word) pairs to shards,
sorted, as a few arrays for each shard; the shard of a word adds the blocks up, seats its pairs and the
word's own tables, and answers in the order of the arrays it was sent.  Only pairs that occur twice or
more are seated: one customer has one table whatever happens.  What shards tell each other
in a sweep is the tables of the restaurants that they both know.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.textkernel import BYTES_FOLDED, U64, Words, chunks, mix
from quire.llm.training import bucket, released
from quire.plans import staging
from quire.plans.staging import drop_stage

BLOCK_BYTES = 12 << 20
PROBE_BYTES = 64 << 20  # of text at most, or a twentieth, tell which words are spread over several shards
WAVES = 4
WIDE = 16
MOVES, GROUPS = 64, 8  # customers of a dish that a sweep moves one by one, and the groups in which it moves the others
PLAIN = ("x", "raw", "p", "n")  # hashes and whole arrays: a dictionary of their values would only be filled and given up
PART = 1 << 17  # pairs whose chances are worked out at a time
COPIES = 64  # rows of one id and text beyond this number are scored as one row
END = np.array([0x5E9D0F1AE2B3C4D5], U64)
BEGIN = np.array([0x1B873593CC9E2D51], U64)


def in_waves(step: Callable[[int], DataFrame]) -> DataFrame:
    """A part of the shards after the other: not all of their pairs are on disk twice at once."""
    out = step(0)
    for wave in range(1, WAVES):
        out = out.unionByName(step(wave))
    return out


def stage(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Stages df, in a folder for each value of parts, and deletes its shuffles' files at once: the sweeps would fill the disk with them."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return staging.stage(df, name, *parts, plain=PLAIN)
    finally:
        conf.set(key, before)


def tokens(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of all tokens in order: the words of each text, then its end."""
    n = len(w.hash) + w.n_docs
    token, doc = np.empty(n, U64), np.empty(n, np.int32)
    ends = w.first()[1:] + np.arange(w.n_docs)
    at = np.arange(len(w.hash)) + w.doc
    token[at], doc[at] = w.hash, w.doc
    token[ends], doc[ends] = END[0], np.arange(w.n_docs)
    return token, doc


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """tokens() of many texts, a chunk after the other: what finds the words of a chunk is many times as large as its text."""
    token, doc = [np.zeros(0, U64)], [np.zeros(0, np.int32)]
    for a, _, w in chunks(texts, BYTES_FOLDED):
        own, at = tokens(w)
        token.append(own)
        doc.append(at + np.int32(a))
    return np.concatenate(token), np.concatenate(doc)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after whose end its memory goes back to the system: a Python worker is kept for its next task, beside others that work."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        released()

    return out


def save(**arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each at a multiple of eight bytes, behind what they are: a few bytes an array."""
    head, data, at = [], [], 0
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        head.append(f"{name} {np.asarray(a).dtype.str} {'x'.join(map(str, np.shape(a)))}")
        data += [raw, bytes(-len(raw) % 8)]
    first = ";".join(head).encode()
    return b"".join([len(first).to_bytes(8, "little"), first, bytes(-len(first) % 8), *data])


def small(name: str, values: np.ndarray) -> dict[str, np.ndarray]:
    """Numbers that are mostly under 255, a byte each, and the others beside them."""
    at = np.flatnonzero(values >= 255)
    return {name: np.minimum(values, 255).astype(np.uint8), f"{name}_at": at.astype(np.uint32), f"{name}_is": values[at].astype(np.int64)}


def whole(z: dict[str, np.ndarray], name: str) -> np.ndarray:
    out = z[name].astype(np.int64)
    out[z[f"{name}_at"]] = z[f"{name}_is"]
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Numbers in as many bytes each as the largest takes: a row of bytes a number."""
    size = max(1, -(-int(values.max()).bit_length() // 8)) if len(values) else 1
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])


def wide(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<i8").ravel().astype(np.int64)


def load(raw: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(raw[:8], "little")
    out, at = {}, 8 + size + -size % 8
    for one in raw[8 : 8 + size].decode().split(";"):
        name, kind, shape = one.split(" ")
        dims = [int(x) for x in shape.split("x")] if shape else []
        n = int(np.prod(dims, dtype=np.int64))
        out[name] = np.frombuffer(raw, kind, n, at).reshape(dims)
        at += n * np.dtype(kind).itemsize
        at += -at % 8
    return out


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(values, return_inverse=True) of 64-bit numbers, by one plain sort: a value's upper bits before its place.

    Where the bits that are left out tell values apart in another order, np.unique does it.
    """
    if not len(values):
        return values, np.zeros(0, np.int32)
    low = U64(max(1, len(values).bit_length()))
    mask = (U64(1) << low) - U64(1)
    mixed = values << U64(64 - max(1, int(values.max()).bit_length()))
    mixed &= ~mask
    mixed |= np.arange(len(values), dtype=U64)
    mixed.sort()
    mixed &= mask
    place = mixed.view(np.int64)
    held = values[place]
    if (held[1:] < held[:-1]).any():
        return np.unique(values, return_inverse=True)
    new = np.r_[True, held[1:] != held[:-1]]
    held = held[new]
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    inverse = np.empty(len(values), np.int32)
    inverse[place] = rank
    return held, inverse


# ---- seating


class Seats:
    """Tables of many dishes, each of n customers: sizes lie one dish after the other, t of them in use."""

    def __init__(self, n: np.ndarray, t: np.ndarray, sizes: np.ndarray, room: np.ndarray):
        self.n, self.t = n.astype(np.int64), t.astype(np.int64)
        self.at = np.cumsum(room) - room
        self.size = np.zeros(int(room.sum()), np.int64)
        self.size[self.places(np.arange(len(n)))[0]] = sizes

    def places(self, dish: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places in use of some dishes, and where each dish's begin (with the end)."""
        t = self.t[dish]
        first = np.r_[0, np.cumsum(t)]
        return np.repeat(self.at[dish] - first[:-1], t) + np.arange(first[-1]), first

    def packed(self) -> np.ndarray:
        return self.size[self.places(np.arange(len(self.n)))[0]]

    def _pick(self, dish: np.ndarray, less: float, rng: np.random.Generator) -> np.ndarray:
        """A table of each dish, by the sizes less a discount."""
        share, out, t = rng.random(len(dish)), self.at[dish], self.t[dish]
        more = np.flatnonzero(t > 1)
        if len(more):
            t = t[more]
            first = np.zeros(len(t) + 1, np.int64)
            np.cumsum(t, out=first[1:])
            place = np.repeat(out[more] - first[:-1], t)
            place += np.arange(first[-1])
            total = np.zeros(len(place) + 1)
            np.cumsum(self.size[place] - less, out=total[1:])
            low, aim = total[first[:-1]], total[first[1:]]
            aim -= low
            aim *= share[more]
            aim += low
            found = np.searchsorted(total, aim, "right")
            found -= 1
            np.maximum(found, first[:-1], out=found)
            np.minimum(found, first[1:] - 1, out=found)
            out[more] = place[found]
        return out

    def leave(self, dish: np.ndarray, rng: np.random.Generator) -> None:
        """One customer of each dish goes; a table that is then empty closes."""
        place = self._pick(dish, 0.0, rng)
        self.size[place] -= 1
        self.n[dish] -= 1
        closed = self.size[place] == 0
        place, dish = place[closed], dish[closed]
        last = self.at[dish] + self.t[dish] - 1
        self.size[place] = self.size[last]
        self.size[last] = 0
        self.t[dish] -= 1

    def come(self, dish: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One customer of each dish takes a table: a new one by the weight `fresh`, else one by its size."""
        t = self.t[dish]
        weight = self.n[dish] - discount * t
        weight += fresh
        opens = rng.random(len(dish)) * weight < fresh
        opens |= t == 0
        old, new = dish[~opens], dish[opens]
        if len(old):
            self.size[self._pick(old, discount, rng)] += 1
        self.size[self.at[new] + self.t[new]] = 1
        self.t[new] += 1
        self.n[dish] += 1

    def sweep(self, fresh: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator, moves: int = MOVES) -> None:
        """Takes all customers of each dish out and seats each again: `moves` one after the other, the others in GROUPS groups."""
        dish = np.flatnonzero(self.n > 1)
        for k in range(moves):
            dish = dish[self.n[dish] > k]
            if not len(dish):
                break
            self.leave(dish, rng)
            self.come(dish, fresh(dish), discount, rng)
        dish = np.flatnonzero(self.n > moves)
        own = rng.spawn(1)[0] if len(dish) else rng  # numbers of their own: the moves of small dishes do not depend on large ones
        for _ in range(GROUPS if len(dish) else 0):
            self.move(dish, -(-(self.n[dish] - moves) // GROUPS), fresh, discount, own)

    def move(self, dish: np.ndarray, many: np.ndarray, fresh: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> None:
        """Takes `many` customers of each dish out, at random, and seats them again by the weights without them.

        A table after the other, of all dishes that have so many at once: how many leave it is hypergeometric given those that
        left the ones before, how many come to it binomial."""
        order = np.argsort(-self.t[dish], kind="stable")
        dish, many = dish[order], many[order]
        begin, t = self.at[dish], self.t[dish]
        wide = int(np.searchsorted(-t, -WIDE, "left"))  # dishes of more tables go one by one
        for b, k, n in zip(begin[:wide].tolist(), many[:wide].tolist(), t[:wide].tolist()):
            self.size[b : b + n] -= rng.multivariate_hypergeometric(self.size[b : b + n], k)
        live = np.searchsorted(-t, -np.arange(1, min(t[0], WIDE) + 1), "right")
        left, rest = many.copy(), self.n[dish].copy()
        for j, m in enumerate(live):
            place = begin[wide:m] + j
            size = self.size[place]
            rest[wide:m] -= size
            take = rng.hypergeometric(size, rest[wide:m], left[wide:m])
            left[wide:m] -= take
            self.size[place] = size - take
        self.n[dish] -= many
        place, first = self.places(dish)
        size = self.size[place]
        keep = size > 0
        rank = np.cumsum(keep) - keep
        rank -= np.repeat(rank[first[:-1]], t)
        self.size[place] = 0
        self.size[(np.repeat(begin, t) + rank)[keep]] = size[keep]
        self.t[dish] = t = np.add.reduceat(keep, first[:-1])
        weight = fresh(dish)
        share = self.n[dish] - discount * t
        opened_ = rng.binomial(many, weight / (weight + share))
        left, come, narrow = many - opened_, [], t <= WIDE
        for d in np.flatnonzero(~narrow).tolist():
            part = self.size[begin[d] : begin[d] + t[d]] - discount
            come.append((slice(begin[d], begin[d] + t[d]), rng.multinomial(left[d], part / part.sum())))
        for j in range(t[narrow].max(initial=0)):
            own = np.flatnonzero(narrow & (t > j))
            place = begin[own] + j
            part = self.size[place] - discount
            add = rng.binomial(left[own], np.clip(part / np.maximum(share[own], 1e-12), 0, 1))
            add = np.where(t[own] == j + 1, left[own], add)  # the last table takes what is left
            left[own] -= add
            share[own] -= part
            come.append((place, add))
        for place, add in come:
            self.size[place] += add
        self.size[np.repeat(begin + t, opened_) + np.arange(opened_.sum()) - np.repeat(np.cumsum(opened_) - opened_, opened_)] = 1
        self.t[dish] += opened_
        self.n[dish] += many

    def resize(self, n: np.ndarray, fresh: Callable[[np.ndarray], np.ndarray], discount: float, rng: np.random.Generator) -> None:
        """Brings the dishes to n customers: so many leave or come, one by one, and all beyond MOVES at once."""
        many = np.flatnonzero(np.abs(n - self.n) > MOVES)
        if len(many):
            more = n[many] - self.n[many] - np.sign(n[many] - self.n[many]) * MOVES
            weight = fresh(many)
            opened_ = rng.binomial(np.maximum(more, 0), weight / (weight + np.maximum(1, self.n[many])))
            opened_ = np.minimum(opened_, np.maximum(0, more - (self.t[many] == 0)))
            opened_ += (self.t[many] == 0) & (more > 0)
            for dish, k, new in zip(many.tolist(), more.tolist(), opened_.tolist()):
                own = self.size[self.at[dish] : self.at[dish] + self.t[dish]]
                if k < 0:  # the largest tables lose customers down to one each
                    gone = -k
                    for top in np.argsort(-own):
                        take = min(gone, int(own[top]) - 1)
                        own[top] -= take
                        gone -= take
                    self.n[dish] += k + gone
                else:
                    first = self.at[dish] + self.t[dish]
                    self.size[first : first + new] = 1
                    self.t[dish] += new
                    self.size[self.at[dish] + np.argmax(self.size[self.at[dish] : first + new])] += k - new
                    self.n[dish] += k
        while len(more := np.flatnonzero(self.n > n)):
            self.leave(more, rng)
        while len(more := np.flatnonzero(self.n < n)):
            self.come(more, fresh(more), discount, rng)


def forward(n: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that n customers open one by one, beyond eight in groups of an eighth of those seated: where sweeps start."""
    t = np.minimum(n, 1)
    at = np.flatnonzero(n > 1)
    seated = np.ones(len(at), np.int64)
    while len(at):
        group = np.minimum(np.maximum(1, seated // 8), n[at] - seated)
        p = fresh[at] / (fresh[at] + np.maximum(seated - discount * t[at], 1e-12))
        t[at] += rng.random(len(at)) < p if group.max() == 1 else rng.binomial(group, p)
        seated += group
        more = seated < n[at]
        at, seated = at[more], seated[more]
    return t


@dataclass
class Weights:
    """Discount and strength of the contexts' restaurants and of their parent, and the parent's totals."""

    d: float = 0.8
    s: float = 1.0
    d0: float = 0.5
    s0: float = 1.0
    customers: float = 0.0
    tables: float = 0.0
    words: int = 0

    def unknown(self) -> float:
        """The parent's weight of a word without customers."""
        return (self.s0 + self.d0 * self.tables) / (self.words + 1)

    def parent(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (np.where(c > 0, c - self.d0 * t, 0.0) + self.unknown()) / (self.s0 + self.customers)

    def predict(self, n: np.ndarray, t: np.ndarray, of_all: np.ndarray, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        return (n - self.d * t + (self.s + self.d * tables) * parent) / (self.s + of_all)


def _sums(top: int, term: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A grid of ends, with the sums of p and of p (1 - p) over 1 .. end, exact up to 4096 and by trapezes beyond."""
    grid = np.r_[np.arange(1, 4097), np.geomspace(4096, max(8192, top), 400)[1:]]
    p = term(grid)
    step = np.diff(grid)
    out = []
    for v in (p, p * (1 - p)):
        add = np.where(step <= 1, v[1:], (v[1:] + v[:-1]) / 2 * step)
        out.append(np.r_[v[0], v[0] + np.cumsum(add)])
    return grid, out[0], out[1]


def flips(count: np.ndarray, term: Callable[[np.ndarray], np.ndarray], rng: np.random.Generator) -> float:
    """A sample of the sum over items of coin flips of probabilities term(1) .. term(count)."""
    count = count[count > 0]
    if not len(count):
        return 0.0
    grid, mean, spread = _sums(int(count.max()), term)
    return max(0.0, float(np.interp(count, grid, mean).sum() + rng.normal() * np.sqrt(max(0.0, np.interp(count, grid, spread).sum()))))


def strength_parts(c: np.ndarray, t: np.ndarray, d: float, s: float, rng: np.random.Generator) -> np.ndarray:
    """Of restaurants of c customers and t tables: the auxiliary sums for the strength and the discount."""
    some = c > 1
    log = -np.log(np.maximum(1e-300, rng.beta(s + 1, c[some] - 1))).sum() if some.any() else 0.0
    yes = flips(t - 1, lambda j: s / (s + d * j), rng)
    return np.array([log, yes, np.maximum(0, t - 1).sum() - yes])


def closed_parts(sizes: np.ndarray, d: float, rng: np.random.Generator) -> float:
    """Of tables: the auxiliary sum for one minus the discount."""
    return flips(sizes - 1, lambda k: (1 - d) / (k - d), rng)


def sampled(log: float, yes: float, no: float, closed: float, rng: np.random.Generator) -> tuple[float, float]:
    """Discount and strength given the auxiliary sums, under flat priors."""
    return float(np.clip(rng.beta(1 + no, 1 + closed), 0.01, 0.99)), float(max(1e-3, rng.gamma(1 + yes, 1 / (1 + log))))


# ---- blocks and shards


@dataclass
class Map:
    """Where pairs go: a word's shard by its hash; pairs of words that are too frequent for one shard by the context too."""

    shards: int
    hot: np.ndarray  # sorted hashes of frequent words
    parts: np.ndarray  # over how many shards each is spread

    def shard(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        out = (mix(word) % U64(self.shards)).astype(np.int64)
        is_hot, at = self.find(word)
        more = (mix(context[is_hot] + U64(9)) % self.parts[at[is_hot]].astype(U64)).astype(np.int64)
        out[is_hot] = (out[is_hot] + more) % self.shards
        return out

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hot):
            return np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.hot, word), len(self.hot) - 1)
        return self.hot[at] == word, at


@dataclass
class Block:
    """The texts of a block: their tokens, and its distinct pairs in the order in which shards get them."""

    doc: np.ndarray
    pair: np.ndarray  # of each token
    word: np.ndarray  # of the pairs
    context: np.ndarray
    n: np.ndarray  # training tokens
    cut: np.ndarray  # where the pairs of each of `shards` begin (with the end)
    shards: np.ndarray


def block_of(texts: pa.Array, trains: np.ndarray, where: Map) -> Block:
    """trains: how often each text is trained on."""
    token, doc = tokens_of(texts)
    released()
    token = np.r_[token, BEGIN]
    kinds, number = distinct(token)
    del token
    number = number.view(np.uint32) if number.dtype == np.int32 else number.astype(np.uint32)
    before = np.r_[number[-1], number[:-2]] if len(doc) else number[:0]
    before[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])] = number[-1]
    code = number[:-1].astype(U64)
    del number
    code *= U64(len(kinds))
    code += before
    del before
    code, pair = distinct(code)
    pair = pair.astype(np.int32, copy=False)
    n = np.bincount(pair, trains.astype(np.float64)[doc], len(code)).astype(np.int64)
    first = code // U64(len(kinds))
    word, context = kinds[first.astype(np.int64)], kinds[(code - first * U64(len(kinds))).astype(np.int64)]
    del code, first
    shard = where.shard(word, context)
    order = np.argsort(shard.astype(np.uint16) if where.shards < 1 << 16 else shard, kind="stable")  # of 16 bits by digits
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    shard = shard[order]
    cut = runs(shard)
    shards = shard[cut]
    word, context, n, pair = word[order], context[order], n[order], place[pair]
    del order, place, shard
    released()
    return Block(doc, pair, word, context, n, np.r_[cut, len(word)], shards)


def runs(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, np.int64)


def gathered(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of a partition; a partition is mostly of one key."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        del held
        keys = table.column(key).to_numpy()
        for k in np.unique(keys):
            yield int(k), table.filter(pa.array(keys == k)) if (keys != k).any() else table


def state_of(words: np.ndarray, w: np.ndarray, x: np.ndarray, **counts: np.ndarray) -> bytes:
    """A shard's state: its pairs rise by word, and counts are mostly small, so that most numbers but hashes take a byte."""
    per = np.bincount(w, minlength=len(words))
    return save(words=words, x=x, **small("per", per), **{k: v for name, values in counts.items() for k, v in small(name, values).items()})


def state_from(raw: bytes) -> dict[str, np.ndarray]:
    z = load(raw)
    counts = {k: whole(z, k) for k in z if f"{k}_at" in z}
    return {"words": z["words"], "x": z["x"], "w": np.repeat(np.arange(len(z["words"]), dtype=np.int32), counts.pop("per")), **counts}


class Shard:
    """All pairs that blocks sent to a shard, added up: pairs are sorted by word and context."""

    def __init__(self, table: pa.Table):
        self.block = table.column("block").to_numpy()
        parts = [load(x) for x in table.column("raw").to_pylist()]
        self.words = np.unique(np.concatenate([z["w"] for z in parts]))
        self.contexts = np.unique(np.concatenate([z["d"] for z in parts]))
        n_contexts = U64(max(1, len(self.contexts)))
        code = np.concatenate([np.repeat(np.searchsorted(self.words, z["w"]).astype(U64) * n_contexts, whole(z, "k")) for z in parts])
        code += np.concatenate([np.searchsorted(self.contexts, z["d"]).astype(U64)[wide(z["x"])] for z in parts])
        code, self.back = distinct(code)
        self.back = self.back.astype(np.int32, copy=False)
        self.w = (code // n_contexts).astype(np.int32)
        self.x = (code - self.w.astype(U64) * n_contexts).astype(np.int32)
        del code
        self.n = np.bincount(self.back, np.concatenate([whole(z, "n") for z in parts]), len(self.w)).astype(np.int64)
        self.ends = np.cumsum([len(z["x"]) for z in parts])
        self.many = np.flatnonzero(self.n > 1)

    def staged(self) -> bytes:
        """Pairs, and which of them each block asked for: these rise, so their steps take a byte each."""
        first = np.r_[0, self.ends[:-1]]
        step = np.diff(self.back.astype(np.int64), prepend=0)
        step[first] = self.back[first]
        per = np.bincount(self.w, minlength=len(self.words))
        return save(block=self.block, ends=self.ends, words=self.words, contexts=self.contexts, x=narrow(self.x), **small("per", per), **small("n", self.n), **small("step", step))

    @classmethod
    def loaded(cls, raw: bytes) -> "Shard":
        z, s = load(raw), cls.__new__(cls)
        s.block, s.ends, s.words, s.contexts, s.x, s.n = z["block"], z["ends"], z["words"], z["contexts"], wide(z["x"]).astype(np.int32), whole(z, "n")
        s.w = np.repeat(np.arange(len(s.words), dtype=np.int32), whole(z, "per"))
        s.many, step = np.flatnonzero(s.n > 1), whole(z, "step")
        s.back = np.empty(len(step), np.int32)
        for lo, hi in zip(np.r_[0, s.ends[:-1]], s.ends):
            np.cumsum(step[lo:hi], dtype=np.int32, out=s.back[lo:hi])
        return s

    def per_word(self, values: np.ndarray, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.bincount(self.w[at], values, len(self.words)).astype(np.int64)


KINDS = "kind int, shard int, x long, c long, t long, raw binary"
STATE, CONTEXT, HOT, SUMS, TABLES, STATIC = range(6)


def _rows(kind: int, shard: int, x=None, c=None, t=None, raw: bytes | None = None) -> pa.RecordBatch:
    size = 1 if x is None else len(x)
    ints = [pa.array(np.asarray(v, np.int64)) if v is not None else pa.nulls(size, pa.int64()) for v in (None if x is None else x.view(np.int64), c, t)]
    bytes_ = pa.nulls(size, pa.binary()) if raw is None else pa.array([raw] * size, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, shard, np.int32)), *ints, bytes_], ["kind", "shard", "x", "c", "t", "raw"])


def request(where: Map) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts by block to the block's pairs for each shard: words (w), pairs a word (k), contexts (d, by place in it x), training counts (n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in gathered(batches, "block"):
            b = block_of(table.column("text").combine_chunks(), table.column("trains").to_numpy(), where)
            del table
            for shard, lo, hi in zip(b.shards, b.cut[:-1], b.cut[1:]):
                head = runs(b.word[lo:hi])
                known, place = distinct(b.context[lo:hi])
                raw = save(w=b.word[lo:hi][head], d=known, x=narrow(place), **small("k", np.diff(np.r_[head, hi - lo])), **small("n", b.n[lo:hi]))
                yield pa.RecordBatch.from_arrays([pa.array([shard % WAVES], pa.int32()), pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([raw], pa.binary())], ["wave", "shard", "block", "raw"])

    return run


def opened(where: Map) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From requests to each shard's first state, all dishes at one table, and what it knows of contexts and hot words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in gathered(batches, "shard"):
            s = Shard(table)
            del table
            hot, _ = where.find(s.words)
            n, singles = s.per_word(s.n), s.per_word(s.n == 1)
            many = s.many
            c = singles + s.per_word(np.ones(len(many)), many)
            root = np.where(hot, 0, np.minimum(c, 1))
            raw = state_of(s.words, s.w[many], s.contexts[s.x[many]], n=n, singles=singles, pn=s.n[many], t=np.ones(len(many), np.int64), sizes=s.n[many], rt=root, rsizes=np.where(hot, 0, c)[root > 0])
            yield _rows(STATE, shard, raw=raw)
            yield _rows(STATIC, shard, raw=s.staged())
            yield _rows(HOT, shard, s.words[hot], n[hot], c[hot])
            kinds = np.array([END[0], END[0], END[0]])
            yield _rows(SUMS, shard, kinds, [n.sum(), ((n > 0) & ~hot).sum(), c.sum()], [0, 1, 2])
            known, t = np.unique(s.x[many], return_counts=True)
            yield _rows(TABLES, shard, s.contexts[known], t=t)

    return run


def reseated(now: Weights, where: Map, hot_c: np.ndarray, hot_t: np.ndarray, turn: int, keep: bool, start: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From a shard's state (raw) and the tables of its contexts' restaurants (x, t) to its next state, after a sweep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in gathered(batches, "shard"):
            part = table.filter(table.column("raw").is_null())
            known = part.column("x").to_numpy().view(U64)
            order = np.argsort(known)
            known, total = known[order], part.column("t").to_numpy()[order]
            z = state_from(table.filter(table.column("raw").is_valid()).column("raw")[0].as_py())
            del table
            rng = np.random.default_rng([turn, shard])
            w, t0 = z["w"], z["t"]
            tables = total[np.searchsorted(known, z["x"])] if len(w) else np.zeros(0, np.int64)
            hot, at = where.find(z["words"])
            of_words = lambda t: z["singles"] + np.bincount(w, t, len(z["words"])).astype(np.int64)
            c, rt = of_words(t0), z["rt"].copy()
            all_c, all_t = c.copy(), rt.copy()
            all_c[hot], all_t[hot] = hot_c[at[hot]], hot_t[at[hot]]

            def fresh(dish: np.ndarray) -> np.ndarray:
                """The weight of a new table: its own dish's tables as they are now, all others as the sweep found them."""
                change, word = seats.t[dish] - t0[dish], w[dish]
                return (now.s + now.d * (tables[dish] + change)) * now.parent(all_c[word] + change, all_t[word])

            if start:
                weight = (now.s + now.d * tables) * now.parent(all_c[w], all_t[w])
                t = forward(z["pn"], weight, now.d, rng)
                first = np.cumsum(t) - t
                sizes = np.ones(int(t.sum()), np.int64)
                sizes[first] += z["pn"] - t
                seats = Seats(z["pn"], t, sizes, z["pn"])
            else:
                seats = Seats(z["pn"], t0, z["sizes"], z["pn"])
                seats.sweep(fresh, now.d, rng)

            new_c = of_words(seats.t)
            own = np.where(hot, 0, new_c)
            root = Seats(np.where(hot, 0, c), rt, z["rsizes"], np.maximum(np.where(hot, 0, c), own))
            weight = lambda dish: np.full(len(dish), now.unknown())
            root.resize(own, weight, now.d0, rng)
            root.sweep(weight, now.d0, rng)
            sizes, rsizes = seats.packed(), root.packed()
            past = {k: v for k, v in z.items() if k.startswith("sample")} | ({f"sample_{k}_{turn}": v for k, v in (("t", seats.t), ("c", new_c), ("rt", root.t))} if keep else {})
            raw = state_of(z["words"], w, z["x"], **{k: z[k] for k in ("n", "singles", "pn")}, t=seats.t, sizes=sizes, rt=root.t, rsizes=rsizes, **past)
            yield _rows(STATE, shard, raw=raw)
            yield _rows(HOT, shard, z["words"][hot], z["n"][hot], new_c[hot])
            closed = [closed_parts(sizes, now.d, rng), closed_parts(rsizes, now.d0, rng)]
            kinds = np.repeat(END, 4)
            yield _rows(SUMS, shard, kinds, [new_c.sum(), root.t.sum(), *(int(round(v)) for v in closed)], [2, 3, 4, 5])
            x, back = distinct(z["x"])
            yield _rows(TABLES, shard, x, t=np.bincount(back, seats.t, len(x)).astype(np.int64))

    return run


def contexts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what shards staged to (shard, x, c, t): contexts, their training tokens and their words that come once."""
    for batch in batches:
        for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("raw")):
            z = load(raw.as_py())
            x, n, known = wide(z["x"]), whole(z, "n"), z["contexts"]
            of = lambda values: pa.array(np.bincount(x, values, len(known)).astype(np.int64))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), shard, np.int32)), pa.array(known.view(np.int64)), of(n), of(n == 1)], ["shard", "x", "c", "t"])


def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From what shards staged to (shard, x): their contexts alone."""
    for batch in batches:
        for shard, raw in zip(batch.column("shard").to_pylist(), batch.column("raw")):
            known = load(raw.as_py())["contexts"]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), shard, np.int32)), pa.array(known.view(np.int64))], ["shard", "x"])


def bundled(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of shard and numbers to a row for each shard and million rows: the numbers as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            held.clear()
            order = np.argsort(table.column("shard").to_numpy(), kind="stable")
            columns = {c: table.column(c).to_numpy()[order] for c in ("shard", *names)}
            shards, first = np.unique(columns["shard"], return_index=True)
            for shard, lo, hi in zip(shards, first, np.r_[first[1:], len(order)]):
                raw = save(x=columns["x"][lo:hi], **{k: v for c in names[1:] for k, v in small(c, columns[c][lo:hi]).items()})
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([raw], pa.binary())], ["shard", "raw"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= 1_000_000:
                yield from out()
        if held:
            yield from out()

    return run


def answered(of: list[Weights], where: Map, hot: list[tuple[np.ndarray, np.ndarray]], hot_n: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From pairs, states and bundles of contexts (c, t0, t1 ..) by shard to answers: log10 of each pair's chance, each word's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, table in gathered(batches, "shard"):
            raw: dict[int, list[bytes]] = {}
            for kind, x in zip(table.column("kind").to_pylist(), table.column("raw").to_pylist()):
                raw.setdefault(kind, []).append(x)
            del table
            s, z = Shard.loaded(raw.pop(STATIC)[0]), state_from(raw.pop(STATE)[0])
            parts = [load(x) for x in raw.pop(CONTEXT)]
            del raw
            known = np.concatenate([p["x"] for p in parts]).view(U64)
            order = np.argsort(known)
            assert (known[order] == s.contexts).all()
            column = lambda c: np.concatenate([whole(p, c) for p in parts])[order]
            customers, tables = column("c"), [column(f"t{k}") for k in range(len(of))]
            del known, order, parts
            is_hot, at = where.find(s.words)
            turns = sorted(int(k.rsplit("_", 1)[1]) for k in z if k.startswith("sample_t_"))
            samples = [{k: z[f"sample_{k}_{turn}"] for k in ("t", "c", "rt")} for turn in turns]
            samples = samples or [{"t": z["t"], "c": z["singles"] + np.bincount(z["w"], z["t"], len(s.words)).astype(np.int64), "rt": z["rt"]}]
            chance = np.zeros(len(s.n))
            for now, sample, total, (hc, ht) in zip(of, samples, tables, hot):
                t = np.minimum(s.n, 1)
                t[s.many] = sample["t"]
                c, rt = sample["c"].copy(), sample["rt"].copy()
                c[is_hot], rt[is_hot] = hc[at[is_hot]], ht[at[is_hot]]
                parent = now.parent(c, rt)
                for a in range(0, len(chance), PART):
                    part = slice(a, a + PART)
                    chance[part] += now.predict(s.n[part], t[part], customers[s.x[part]], total[s.x[part]], parent[s.w[part]])
            chance /= len(of)
            score = np.log10(chance, out=chance).astype("<f4")
            del chance, samples, customers, tables
            count = z["n"].copy()
            count[is_hot] = hot_n[at[is_hot]]
            for block, lo, hi in zip(s.block, np.r_[0, s.ends[:-1]], s.ends):
                own = s.back[lo:hi]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([shard], pa.int32()), pa.array([score[own].tobytes()], pa.binary()), pa.array([save(**small("n", count[s.w[own][runs(s.w[own])]]))], pa.binary())], ["block", "shard", "p", "n"])

    return run


def added_up(where: Map, n_all: int, n_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From texts and answers by block to the texts' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in gathered(batches, "block"):
            texts = table.filter(table.column("shard").is_null())
            told = table.filter(table.column("shard").is_valid()).select(["shard", "p", "n"]).to_pylist()
            del table
            if not texts.num_rows:
                continue
            text, trains = texts.column("text").combine_chunks(), texts.column("trains").to_numpy()
            texts = texts.select(["id", "held_out", "copies"])
            b = block_of(text, trains, where)
            del text
            told = {r["shard"]: r for r in told}
            score, count = np.zeros(len(b.word)), np.zeros(len(b.word), np.int64)
            for shard, lo, hi in zip(b.shards.tolist(), b.cut[:-1], b.cut[1:]):
                score[lo:hi] = np.frombuffer(told[shard]["p"], "<f4")
                head = runs(b.word[lo:hi])
                count[lo:hi] = np.repeat(whole(load(told[shard]["n"]), "n"), np.diff(np.r_[head, hi - lo]))
            base = np.log10((count + 1) / (n_all + n_words + 1))
            per = lambda v: np.bincount(b.doc, v[b.pair], texts.num_rows)
            ints = [np.bincount(b.doc, minlength=texts.num_rows).astype(np.int64), per(count > 0).astype(np.int64)]
            yield pa.RecordBatch.from_arrays(
                [*(texts.column(c).combine_chunks() for c in ("id", "held_out", "copies")), *(pa.array(v) for v in (*ints, per(base), per(score)))],
                ["id", "held_out", "copies", "n_tokens", "n_known", "base_score", "score"])

    return run


def frequent(docs: DataFrame, size: int, shards: int) -> Map:
    """The words that hold over a quarter of a shard's tokens, by a sample: it decides where work is done, not what comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, _ = tokens_of(batch.column("text"))
            word, n = np.unique(token, return_counts=True)
            some = n * 8 * shards > len(token)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[word[some].view(np.int64), 0]), pa.array(np.r_[n[some], len(token)])], ["word", "n"])

    if shards == 1:
        return Map(1, np.zeros(0, U64), np.zeros(0, np.int64))
    part = docs.select("text").sample(min(1.0, max(0.05, PROBE_BYTES / max(1, size))), seed=1)
    found = stage(part.mapInArrow(lean(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = found.where("word = 0").agg(F.sum("n")).first()[0] or 0
    rows = found.where((F.col("word") != 0) & (F.col("n") * 4 * shards > total)).collect()  # at most 4 * shards
    drop_stage(found)
    rows.sort(key=lambda r: r["word"] % (1 << 64))
    parts = [min(shards, -(-4 * shards * r["n"] // total)) for r in rows]
    return Map(shards, np.array([r["word"] for r in rows], np.int64).view(U64), np.array(parts, np.int64))


def once(rows: DataFrame) -> DataFrame:
    """rows (id, text, held_out) with copies: rows of one id and text beyond COPIES of them are one row that says how many.

    Else a block, which is a task's, could be one text's copies without end.
    """
    h = [F.xxhash64("id", "text").alias("h1"), F.xxhash64("text", F.lit(3), "id").alias("h2")]
    many = stage(rows.select(*h).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > COPIES), "copies")
    if many.limit(1).count() == 0:
        drop_stage(many)
        return rows.withColumn("copies", F.lit(1).cast("long"))
    told = rows.select("*", *h).join(many, ["h1", "h2"], "left")
    single = told.where("copies IS NULL").withColumn("copies", F.lit(1).cast("long"))
    first = told.where("copies IS NOT NULL").groupBy("h1", "h2").agg(*(F.first(c).alias(c) for c in ("id", "text", "held_out", "copies")))
    return single.unionByName(first).drop("h1", "h2")


@dataclass
class Sample:
    weights: Weights
    hot: tuple[np.ndarray, np.ndarray]
    totals: DataFrame  # x, c, t: customers and tables of each context's restaurant


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2, burn_in: int = 2, samples: int = 2) -> DataFrame:
    """One row per row of docs: the id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Rows whose crc32 of the id as text leaves `held` modulo folds are held out; all others (also those
    without an id) train the model.  Tokens are the words, A-Z lower-cased, and one end; a null or
    empty text is an end alone.  base_score is the log10 probability under counts plus one, score that
    under the model, whose unknown word has the base's chance.  Repeated rows train and are scored like
    any others (as one row that counts so often, where there are many); other columns are left out; an empty table gives no rows.  The first of the burn_in sweeps
    seats all customers; with no samples all dishes stay at one table.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    ident, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(ident.alias("id"), text.alias("text"), F.coalesce(bucket(ident, folds) == held, F.lit(False)).alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    where = frequent(rows, size, blocks)
    rows = once(rows)
    trains = F.when(F.col("held_out"), 0).otherwise(F.col("copies")).cast("long")
    placed = rows.withColumns({"trains": trains, "block": F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")})
    by = lambda df, key: df.repartitionById(blocks, F.col(key))

    requests = by(placed, "block").select("text", "trains", "block").mapInArrow(lean(request(where)), "wave int, shard int, block int, raw binary")
    requests = stage(requests, "requests", "wave")
    state = in_waves(lambda wave: stage(by(requests.where(F.col("wave") == wave), "shard").mapInArrow(lean(opened(where)), KINDS), "opened"))
    drop_stage(requests)
    static = state.where(F.col("kind") == STATIC)
    contexts = static.select("shard", "raw").mapInArrow(lean(contexts_of), "shard int, x long, c long, t long")
    all_x = stage(contexts.groupBy("x").agg(F.sum("c").alias("c"), F.sum("t").alias("t")), "contexts")
    first, rng = state, np.random.default_rng(11)

    def sums(df: DataFrame) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
        """The shards' sums, and both numbers of each hot word: there are at most four to a shard."""
        got, hot = {}, np.zeros((2, len(where.hot)), np.int64)
        which = F.when(F.col("kind") == SUMS, F.col("t")).alias("which")
        for r in df.where(F.col("kind").isin(SUMS, HOT)).groupBy("kind", which, "x").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).collect():
            if r["kind"] == SUMS:
                got[r["which"]] = r["c"]
            else:
                hot[:, np.searchsorted(where.hot, np.array([r["x"]], np.int64).view(U64))[0]] = r["c"], r["t"]
        return got, hot[0], hot[1]

    got, hot_n, hot_c = sums(state)
    n_all = got.get(0) or 0
    n_words = (got.get(1) or 0) + int((hot_n > 0).sum())
    hot_seats = Seats(hot_c, np.minimum(hot_c, 1), hot_c[hot_c > 0], hot_n)
    now = Weights(customers=float(got.get(2) or 0), tables=float(n_words), words=n_words)
    taken: list[Sample] = []

    def totals(df: DataFrame) -> DataFrame:
        own = df.where(F.col("kind") == TABLES).groupBy("x").agg(F.sum("t").alias("own"))
        return stage(all_x.join(own, "x", "left").select("x", "c", (F.col("t") + F.coalesce("own", F.lit(0))).alias("t")), "totals")

    now_totals = totals(state)
    if not samples:
        taken.append(Sample(now, (hot_c, hot_seats.t.copy()), now_totals))
    for turn in range(burn_in + samples if samples else 0):
        keep = turn >= burn_in
        need = state.where(F.col("kind") == TABLES).select("shard", "x").join(now_totals.select("x", "t"), "x")
        need = need.select("shard", "x", "t", F.lit(None).cast("binary").alias("raw"))
        new = by(state.where(F.col("kind") == STATE).select("shard", "x", "t", "raw").unionByName(need), "shard").mapInArrow(lean(reseated(now, where, hot_c, hot_seats.t.copy(), turn, keep, turn == 0)), KINDS)
        new = stage(new, "seated")
        if state is not first:
            drop_stage(state)
        state = new
        got, _, hot_c = sums(new)
        weight = lambda dish: np.full(len(dish), now.unknown())  # noqa: B023, E731
        hot_seats.resize(hot_c, weight, now.d0, rng)
        hot_seats.sweep(weight, now.d0, rng)
        if not (taken and taken[-1].totals is now_totals):
            drop_stage(now_totals)
        now_totals = totals(state)
        customers, tables = float(got.get(2) or 0), float((got.get(3) or 0) + hot_seats.t.sum())
        parts = now_totals.select("c", "t").mapInArrow(_strength(now, turn), "log double, yes double, no double").agg(*(F.sum(c) for c in ("log", "yes", "no"))).first()
        d, s = sampled(*(float(v or 0) for v in parts), float(got.get(4) or 0), rng)
        root = strength_parts(np.array([customers]), np.array([int(tables)]), now.d0, now.s0, rng)
        closed = float(got.get(5) or 0) + closed_parts(hot_seats.packed(), now.d0, rng)
        d0, s0 = sampled(*root, closed, rng)
        now = Weights(d, s, d0, s0, customers, tables, n_words)
        if keep:
            taken.append(Sample(now, (hot_c, hot_seats.t.copy()), now_totals))

    told = taken[0].totals.select("x", "c", F.col("t").alias("t0"))
    for k, sample in enumerate(taken[1:], 1):
        told = told.join(sample.totals.select("x", F.col("t").alias(f"t{k}")), "x")
    names = ["x", "c", *(f"t{k}" for k in range(len(taken)))]
    of_shards = static.select("shard", "raw").mapInArrow(lean(named), "shard int, x long")
    known = stage(of_shards.join(told, "x").select("shard", *names).mapInArrow(lean(bundled(names)), "shard int, raw binary"), "known")
    for table in {id(t): t for t in (all_x, now_totals, *(x.totals for x in taken))}.values():
        drop_stage(table)
    answer = answered([x.weights for x in taken], where, [x.hot for x in taken], hot_n)
    of_kind = lambda df, kind: df.select(F.lit(kind).alias("kind"), "shard", "raw")
    all_ = of_kind(static, STATIC).unionByName(of_kind(state.where(F.col("kind") == STATE), STATE)).unionByName(of_kind(known, CONTEXT))
    of_wave = lambda wave: all_.where(F.pmod("shard", F.lit(WAVES)) == wave)
    answers = in_waves(lambda wave: stage(by(of_wave(wave), "shard").mapInArrow(lean(answer), "block int, shard int, p binary, n binary"), "answers"))
    for table in {id(t): t for t in (first, state, known)}.values():
        drop_stage(table)
    none = lambda kind: F.lit(None).cast(kind)
    both = placed.select("block", "id", "text", "held_out", "copies", "trains", none("int").alias("shard"), none("binary").alias("p"), none("binary").alias("n")).unionByName(
        answers.select("block", none(id_type).alias("id"), none("string").alias("text"), none("boolean").alias("held_out"), none("long").alias("copies"), none("long").alias("trains"), "shard", "p", "n"))
    scored = by(both, "block").mapInArrow(lean(added_up(where, n_all, n_words)), f"id {id_type}, held_out boolean, copies long, n_tokens long, n_known long, base_score double, score double")
    scored = scored.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return scored.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")


def _strength(now: Weights, turn: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, t = batch.column("c").to_numpy(), batch.column("t").to_numpy()
            if len(c):
                parts = strength_parts(c, t, now.d, now.s, np.random.default_rng([turn, int(c.sum()), int(t.sum())]))
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in parts], ["log", "yes", "no"])

    return run
