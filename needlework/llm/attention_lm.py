"""Operator 8: scoring by a causal self-attention model trained in numpy on subword ids.

Ids come from a public byte-level vocabulary. By their counts over the whole corpus the ``OWN`` most frequent are classes of their own; the others are spread over ``GROUPS``
further classes, in each of which the ``MEMBERS - 1`` most frequent are members of their own and the rest share the last member by their counts: p(id) = p(class | context)
p(member | class, context) p(id | member). The model embeds the input ids, attends causally over the embeddings (a bilinear form and a learned bias per distance), adds what
it attended to, projected, to the last embedding, and predicts class and member of the next id from that, each group's members by weights of their own.

Training is by parallel averaging over every document of the corpus. A hash puts each document into one of the rounds, which grow as ``ROUNDS``, and into one of the round's
replicas, as many as its tokens fill; each replica runs Adam over its blocks from the common weights, and the mean of the replicas' weights by tokens starts the next round. So
each document is trained on once, and all weights are trained on it; corpora of fewer than ``LEAST_TOKENS`` are gone over again until as many were seen.

Scoring runs over blocks of ``STRIDE`` ids; each block is seen with the ``CONTEXT - STRIDE`` ids before it (a start mark at the text's beginning), so windows overlap and
every id is scored exactly once, in batches of masked attention.

Result: doc_id, n_tokens, nll (sum of -log p, nats) and mean_nll. Nulls and empty texts have 0 tokens, nll 0 and no mean. A null doc_id is carried. Repeated rows are trained on and
scored each. Very long texts are trained on and scored whole, in parts that see what stands before them. An empty table gives an empty result. Columns other than doc_id and text
are ignored.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from needlework.llm.scratch import load, written
from needlework.llm.subwords import DEFAULT_VOCABULARY, packer

CONTEXT = 32
STRIDE = 24
WIDTH = 16
OWN = 16
GROUPS = 16
MEMBERS = 32
INPUTS = 4096
ROUNDS = (1, 3, 12)
LEAST_TOKENS = 1 << 20
REPLICA_TOKENS = 1 << 21
#: tasks of a round; more replicas take turns in them
MOST_TASKS = 20_000
#: blocks of CONTEXT ids in a step of Adam, and in a buffer whose blocks are shuffled
BATCH = 256
BUFFER = 4096
RATE = 0.015
#: longer documents are handled in parts of so many ids, a multiple of CONTEXT and of STRIDE
PART = 96 << 10
CHUNK = 4096
SAFE = 60.0


class Classes:
    """Classes and members of the ids and their input symbols, by the ids' counts; symbol 0 is the start mark, 1 pads."""

    def __init__(self, counts: np.ndarray):
        n = len(counts)
        by = np.argsort(-counts, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by] = np.arange(n)
        below = np.maximum(rank - OWN, 0)
        group = below % GROUPS
        self.of = np.where(rank < OWN, rank, OWN + group).astype(np.uint8)
        self.member = np.minimum(below // GROUPS, MEMBERS - 1).astype(np.uint8)
        weight = counts + 1.0
        cell = np.where(rank < OWN, rank, OWN + group * MEMBERS + self.member)
        of_cell = np.bincount(cell, weight, OWN + GROUPS * MEMBERS)
        of_member = of_cell[OWN:].reshape(GROUPS, MEMBERS)
        of_class = np.maximum(np.concatenate([of_cell[:OWN], of_member.sum(axis=1)]), 1)
        self.within = (np.log(weight) - np.log(of_cell[cell])).astype(np.float32)
        self.prior = np.log(of_class / of_class.sum()).astype(np.float32)
        self.member_prior = np.log(np.maximum(of_member, 1e-3) / of_class[OWN:, None]).astype(np.float32)
        top = min(INPUTS, n)
        self.symbol = (2 + np.where(rank < top, rank, top + group)).astype(np.int32)
        self.symbols = 2 + top + GROUPS


def shapes(classes: Classes) -> dict[str, tuple[int, ...]]:
    """e: embeddings; q, v: what they ask for and what is taken from those attended to; r: bias per distance; u: classes; s: members of each group. The last row of u and s is added as it is."""
    return {"e": (classes.symbols, WIDTH), "q": (WIDTH, WIDTH), "v": (WIDTH, WIDTH), "r": (CONTEXT,), "u": (WIDTH + 1, OWN + GROUPS), "s": (GROUPS, WIDTH + 1, MEMBERS)}


def start(classes: Classes) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(8))
    scale = {"e": 0.3, "q": 1 / math.sqrt(WIDTH), "v": 1 / math.sqrt(WIDTH), "r": 0.0, "u": 0.1, "s": 0.1}
    out = {name: rng.normal(0, scale[name], shape).astype(np.float32) for name, shape in shapes(classes).items()}
    out["u"][WIDTH] = classes.prior
    out["s"][:, WIDTH] = classes.member_prior
    return out


def flat(model: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in model.values()])


def unflat(x: np.ndarray, classes: Classes) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in shapes(classes).items():
        n = math.prod(shape)
        out[name] = x[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


def parts(ids: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(document, start, stop) of the documents' parts, none longer than PART; none of empty ones."""
    return [(d, a, min(a + PART, len(x))) for d, x in enumerate(ids) for a in range(0, len(x), PART)]


def lines(ids: list[np.ndarray], pieces: list[tuple[int, int, int]], classes: Classes, size: int, before: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of documents in blocks of ``size`` targets: inputs in a row, each piece after the ``before`` inputs that it sees (pads at a text's beginning); the targets
    likewise (-1: none); and for each block where its first visible input stands, and its document."""
    n = np.array([b - a for _, a, b in pieces], np.int64)
    many = -(-n // size)
    length = many * size + before
    begin = np.cumsum(length) - length
    line = np.ones(int(length.sum()) + 1, np.int32)
    goal = np.full(int(length.sum()) + 1, -1, np.int32)
    if len(pieces):
        everything = np.concatenate([ids[d][a:b] for d, a, b in pieces]).astype(np.int32)
        where = np.arange(len(everything)) + np.repeat(begin + before - (np.cumsum(n) - n), n)
        goal[where] = everything
        line[where + 1] = classes.symbol.take(everything)
        # what follows a piece's last id may stand where the next piece begins
        line[begin] = 1
        line[begin + before] = 0
        for (d, a, _), at in zip(pieces, begin.tolist(), strict=True):
            if a:
                line[at : at + before + 1] = classes.symbol[ids[d][a - before - 1 : a]]
    total = int(many.sum())
    block = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
    return line, goal, np.repeat(begin, many) + block * size, np.repeat(np.array([d for d, _, _ in pieces], np.int64), many)


_AHEAD = np.arange(CONTEXT)[:, None] - np.arange(CONTEXT)[None, :]
SEEN = _AHEAD >= 0
DISTANCE = np.clip(_AHEAD, 0, CONTEXT - 1)
_LATER = np.where(SEEN, 0, -1e4).astype(np.float32)


def by_group(chosen: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The places of ids that share a class, in order of the class, and where each class begins."""
    order = np.argsort(chosen, kind="stable")
    ends = np.cumsum(np.bincount(chosen, minlength=OWN + GROUPS))
    first = ends[OWN - 1]
    return order[first:], (ends[OWN - 1 :] - first).tolist()


def settle(z: np.ndarray) -> None:
    """Take the greatest off each row where exponents could leave the range of 32-bit floats."""
    if not z.size or -SAFE < z.max() < SAFE:
        return
    z -= z.max(axis=-1, keepdims=True)


class Scorer:
    """The model with what each symbol asks for in a table."""

    def __init__(self, model: dict[str, np.ndarray], classes: Classes):
        self.model, self.classes = model, classes
        e = model["e"]
        self.x = e
        self.q = (e @ model["q"] / math.sqrt(WIDTH)).astype(np.float32)
        # the last column sums the weights; a pad has neither values nor weight
        self.ones = np.hstack([e, np.ones((len(e), 1))]).astype(np.float32)
        self.ones[1] = 0
        self.bias = (model["r"][DISTANCE] + _LATER).astype(np.float32)
        most = max(float(np.abs(self.q[i : i + 512] @ e.T).max()) for i in range(0, len(e), 512)) + float(np.abs(model["r"]).max())
        self.safe = most < SAFE

    def states(self, inputs: np.ndarray, out: np.ndarray, size: int) -> None:
        """What the last ``size`` places of each block predict from, and 1."""
        last = inputs[:, CONTEXT - size :]
        seen = self.ones.take(inputs, axis=0)
        a = np.matmul(self.q.take(last, axis=0), seen[:, :, :WIDTH].transpose(0, 2, 1))
        a += self.bias[CONTEXT - size :]
        if not self.safe:
            a = np.where((inputs == 1)[:, None, :], np.float32(-1e4), a)
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        o = np.matmul(a, seen).reshape(-1, WIDTH + 1)
        o /= o[:, WIDTH:]
        np.add(o[:, :WIDTH] @ self.model["v"], self.x.take(last.ravel(), axis=0), out=out[:, :WIDTH])
        out[:, WIDTH] = 1

    def score(self, ids: list[np.ndarray], step: int = 64, batch: int = 512) -> np.ndarray:
        """Sum of -log p of each document."""
        out = np.zeros(len(ids))
        held: list[tuple[int, int, int]] = []
        size = 0
        for piece in parts(ids):
            held.append(piece)
            size += piece[2] - piece[1]
            if size >= PART:
                self.add(ids, held, out, step, batch)
                held, size = [], 0
        if held:
            self.add(ids, held, out, step, batch)
        return out

    def add(self, ids: list[np.ndarray], pieces: list[tuple[int, int, int]], out: np.ndarray, step: int, batch: int) -> None:
        before, classes, u, s = CONTEXT - STRIDE, self.classes, self.model["u"], self.model["s"]
        line, goal, begin, document = lines(ids, pieces, classes, STRIDE, before)
        states = np.empty((batch * STRIDE, WIDTH + 1), np.float32)
        for at in range(0, len(begin), batch):
            first = begin[at : at + batch]
            for i in range(0, len(first), step):
                part = first[i : i + step]
                self.states(line[part[:, None] + np.arange(CONTEXT)], states[i * STRIDE : (i + len(part)) * STRIDE], STRIDE)
            y = goal[first[:, None] + np.arange(before, CONTEXT)].ravel()
            who = np.repeat(document[at : at + batch], STRIDE)
            h = states[: len(y)]
            if y.min() < 0:
                real = y >= 0
                h, y, who = h[real], y[real], who[real]
            chosen, member = classes.of.take(y), classes.member.take(y)
            order, ends = by_group(chosen)
            loss = below(h @ u, chosen)
            h = h.take(order, axis=0)
            z = np.empty((len(h), MEMBERS), np.float32)
            for g in range(GROUPS):
                np.matmul(h[ends[g] : ends[g + 1]], s[g], out=z[ends[g] : ends[g + 1]])
            loss -= classes.within.take(y)
            out += np.bincount(who, loss, len(out)) + np.bincount(who.take(order), below(z, member.take(order)), len(out))


def below(z: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """-log softmax of each row at its chosen column; z is used up."""
    settle(z)
    at = np.arange(len(z)) * z.shape[1] + chosen
    picked = z.ravel().take(at)
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], z.dtype)) - picked


def downhill(z: np.ndarray, chosen: np.ndarray, weight: np.ndarray) -> float:
    """The weighted sum of -log softmax of the rows at their chosen columns; z becomes its gradient."""
    settle(z)
    at = np.arange(len(z)) * z.shape[1] + chosen
    picked = z.ravel().take(at)
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    z *= (weight / total)[:, None]
    z.reshape(-1)[at] -= weight
    return float(((np.log(total) - picked) * weight).sum())


def heads(model: dict[str, np.ndarray], h: np.ndarray, goals: np.ndarray, classes: Classes) -> tuple[float, dict[str, np.ndarray], tuple]:
    """Mean loss of the goals (ids, -1 where there is none) predicted from the rows of h, the gradients of u and s, and what those of h need."""
    u, s, kind = model["u"], model["s"], h.dtype
    y = goals.ravel()
    real = y >= 0
    weight = real.astype(kind)
    weight *= kind.type(1 / max(1, int(real.sum())))
    y = np.maximum(y, 0)
    chosen, member = classes.of.take(y), classes.member.take(y)
    z1 = h @ u
    loss = downhill(z1, chosen, weight)
    order, ends = by_group(chosen)
    hs = h.take(order, axis=0)
    z2 = np.empty((len(order), MEMBERS), kind)
    for g in range(GROUPS):
        np.matmul(hs[ends[g] : ends[g + 1]], s[g], out=z2[ends[g] : ends[g + 1]])
    loss += downhill(z2, member.take(order), weight.take(order))
    of_s = np.empty_like(s)
    for g in range(GROUPS):
        np.matmul(hs[ends[g] : ends[g + 1]].T, z2[ends[g] : ends[g + 1]], out=of_s[g])
    return loss, {"u": h.T @ z1, "s": of_s}, (z1, z2, order, ends)


def gradients(model: dict[str, np.ndarray], inputs: np.ndarray, goals: np.ndarray, classes: Classes) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over the targets of blocks of CONTEXT places (goals: ids, -1 where there is none), what lies within members aside, and its gradients."""
    e, u, s = (model[x] for x in "eus")
    kind, n, blocks = e.dtype, inputs.size, len(inputs)
    scale = kind.type(1 / math.sqrt(WIDTH))
    seen = inputs.ravel()
    x = e.take(seen, axis=0)
    x3 = x.reshape(blocks, CONTEXT, WIDTH)
    # weights and then their gradients, side by side with what their transposes are multiplied by
    both = np.empty((blocks, 2, CONTEXT, CONTEXT), kind)
    times = np.empty((blocks, 2, CONTEXT, WIDTH), kind)
    q = times[:, 1]
    np.multiply((x @ model["q"]).reshape(x3.shape), scale, out=q)
    a, da = both[:, 0], both[:, 1]
    np.matmul(q, x3.transpose(0, 2, 1), out=a)
    a += (model["r"][DISTANCE] + _LATER).astype(kind)
    if a.max() > SAFE:
        a -= a.max(axis=2, keepdims=True)
    np.exp(a, out=a)
    # weights stay as they are; what they sum to is divided out of what they are multiplied by
    share = (1 / (a @ np.ones(CONTEXT, kind))).reshape(n, 1)
    o = np.matmul(a, x3).reshape(n, WIDTH)
    o *= share
    h = np.empty((n, WIDTH + 1), kind)
    np.add(o @ model["v"], x, out=h[:, :WIDTH])
    h[:, WIDTH] = 1
    loss, out, (z1, z2, order, ends) = heads(model, h, goals, classes)
    dh = z1 @ u[:WIDTH].T
    dhs = np.empty((len(order), WIDTH), kind)
    back = np.ascontiguousarray(s[:, :WIDTH].transpose(0, 2, 1))
    for g in range(GROUPS):
        np.matmul(z2[ends[g] : ends[g + 1]], back[g], out=dhs[ends[g] : ends[g + 1]])
    dh[order] += dhs
    out["v"] = o.T @ dh
    np.matmul(dh, model["v"].T, out=(do := np.empty((n, WIDTH), kind)))
    do *= share
    # the mean of do x over what is attended to is do o
    mean = np.einsum("ij,ij->i", do, o).reshape(blocks, CONTEXT, 1)
    do = do.reshape(x3.shape)
    times[:, 0] = do
    np.matmul(do, x3.transpose(0, 2, 1), out=da)
    da -= mean
    da *= a
    out["r"] = np.bincount(DISTANCE.ravel(), (da.sum(axis=0) * SEEN).ravel(), CONTEXT)
    dq = np.matmul(da, x3).reshape(n, WIDTH)
    dq *= scale
    out["q"] = x.T @ dq
    dx = np.matmul(both.reshape(blocks, 2 * CONTEXT, CONTEXT).transpose(0, 2, 1), times.reshape(blocks, 2 * CONTEXT, WIDTH)).reshape(n, WIDTH)
    dx += dq @ model["q"].T
    dx += dh
    # rows of each symbol are summed side by side
    by = np.argsort(seen.astype(np.uint16), kind="stable")
    first = np.flatnonzero(np.diff(seen.take(by), prepend=-1))
    out["e"] = np.zeros_like(e)
    out["e"][seen.take(by.take(first))] = np.add.reduceat(dx.take(by, axis=0), first, axis=0)
    return loss, {name: out[name].astype(kind, copy=False) for name in model}


class Trainer:
    """Adam over the blocks of documents as they come in, shuffled within buffers by a fixed seed; each batch is a step."""

    def __init__(self, model: dict[str, np.ndarray], classes: Classes, rate: float = RATE, inner: bool = True):
        self.model = {k: v.copy() for k, v in model.items()}
        self.classes, self.rate = classes, rate
        self.m = {k: np.zeros_like(v) for k, v in model.items()}
        self.s = {k: np.zeros_like(v) for k, v in model.items()}
        # where embeddings and attention stay as they are, what they give is looked up
        self.fixed = None if inner else Scorer(self.model, classes)
        self.rng = np.random.Generator(np.random.PCG64(1))
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.steps = self.tokens = 0
        self.loss = 0.0

    def add(self, ids: list[np.ndarray]) -> None:
        todo: list[tuple[int, int, int]] = []
        size = 0
        for piece in parts(ids):
            todo.append(piece)
            size += piece[2] - piece[1]
            if size >= PART:
                self.take(ids, todo)
                todo, size = [], 0
        if todo:
            self.take(ids, todo)

    def take(self, ids: list[np.ndarray], pieces: list[tuple[int, int, int]]) -> None:
        line, goal, begin, _ = lines(ids, pieces, self.classes, CONTEXT, 0)
        at = begin[:, None] + np.arange(CONTEXT)
        inputs = line[at]
        self.held.append((inputs, goal[at]))
        self.size += len(begin)
        if self.size >= BUFFER:
            self.run()

    def run(self) -> None:
        if not self.size:
            return
        inputs, goals = (np.concatenate([x[i] for x in self.held]) for i in (0, 1))
        order = self.rng.permutation(len(inputs))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.step(inputs[pick], goals[pick])
        self.held, self.size = [], 0

    def step(self, inputs: np.ndarray, goals: np.ndarray) -> None:
        if self.fixed is None:
            loss, g = gradients(self.model, inputs, goals, self.classes)
        else:
            h = np.empty((inputs.size, WIDTH + 1), np.float32)
            for i in range(0, len(inputs), 32):
                self.fixed.states(inputs[i : i + 32], h[i * CONTEXT : (i + 32) * CONTEXT], CONTEXT)
            loss, g, _ = heads(self.model, h, goals, self.classes)
        n = int((goals >= 0).sum())
        self.steps += 1
        self.tokens += n
        self.loss += loss * n
        t = self.steps
        rate = self.rate / math.sqrt(1 + t / 100) / (1 - 0.9**t)
        for k, x in g.items():
            m, s = self.m[k], self.s[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * x
            x *= x
            x *= np.float32(0.01)
            s *= np.float32(0.99)
            s += x
            np.sqrt(s, out=x)
            x *= np.float32(1 / math.sqrt(1 - 0.99**t))
            x += np.float32(1e-6)
            np.divide(m, x, out=x)
            x *= np.float32(rate)
            self.model[k] -= x

    def end(self) -> tuple[dict[str, np.ndarray], float]:
        """The weights and the mean loss."""
        self.run()
        return self.model, self.loss / max(1, self.tokens)


def train(model: dict[str, np.ndarray], ids: list[np.ndarray], classes: Classes, rate: float = RATE, inner: bool = True) -> tuple[dict[str, np.ndarray], float]:
    """One pass over the documents; the model and the mean loss."""
    trainer = Trainer(model, classes, rate, inner)
    trainer.add(ids)
    return trainer.end()


def keep_memory() -> None:
    """What arrays leave free stays with the process, so that the system needn't map and clear it for the next ones; nothing changes where malloc has no such options."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt is not None:
        # M_MMAP_THRESHOLD, M_TRIM_THRESHOLD
        mallopt(-3, 32 << 20)
        mallopt(-1, 256 << 20)


def unpack(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint16) for x in column.to_pylist()]


def encoded(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, ids (16-bit numbers) of docs(doc_id, text)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = packer(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([words.pack(x or "") for x in part.column(1).to_pylist()], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id long, ids binary")


def counted(coded: DataFrame) -> np.ndarray:
    """Occurrences of each id in the corpus; the result is as large as the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in unpack(batch.column(0)):
                for at in range(0, len(x), 1 << 20):
                    part = x[at : at + (1 << 20)]
                    if len(part) < 4096:
                        np.add.at(total, part, 1)
                    else:
                        total += np.bincount(part, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["id", "n"])

    out = np.zeros(1 << 16, np.int64)
    for r in coded.select("ids").mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


WEIGHTS = "chunk int, n long, weights binary"


def chunks(total: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows of WEIGHTS: the mean of weights, of which ``total`` is the sum by tokens, in pieces of CHUNK."""
    mean = (total / max(1, n)).astype(np.float32)
    pieces = [mean[i : i + CHUNK].tobytes() for i in range(0, len(mean), CHUNK)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array([n] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], ["chunk", "n", "weights"])


def learner(shared):
    """Trains the replicas of a task, one after the other, each from the shared weights; their mean by tokens. Rows (replica, ids) come ordered by replica."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        weights, classes, rate, inner = shared.value
        model = unflat(weights, classes)
        total, n = np.zeros(len(weights)), 0
        now, trainer = None, None

        def close() -> None:
            nonlocal n
            new, _ = trainer.end()
            total[:] += trainer.tokens * flat(new).astype(np.float64)
            n += trainer.tokens

        for batch in batches:
            if not batch.num_rows:
                continue
            replica = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(replica)) + 1).tolist(), len(replica)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if replica[a] != now:
                    if trainer is not None:
                        close()
                    now, trainer = replica[a], Trainer(model, classes, rate, inner)
                for at in range(a, b, 512):
                    trainer.add(unpack(batch.column(1).slice(at, min(512, b - at))))
        if trainer is not None:
            close()
            yield chunks(total, n)

    return learn


def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The mean by tokens of all rows of each chunk."""
    total: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for batch in batches:
        for chunk, n, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            total[chunk] = total.get(chunk, 0) + n * np.frombuffer(x, np.float32).astype(np.float64)
            tokens[chunk] = tokens.get(chunk, 0) + n
    mean = [(x / tokens[c]).astype(np.float32).tobytes() for c, x in total.items()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(tokens.values()), pa.int64()), pa.array(mean, pa.binary())], ["chunk", "n", "weights"])


def fit(
    coded: DataFrame, classes: Classes, rounds: tuple[int, ...] = ROUNDS, replica_tokens: int = REPLICA_TOKENS, least_tokens: int = LEAST_TOKENS, rate: float = RATE, whole: bool = False
) -> dict[str, np.ndarray]:
    """Train on all of coded(doc_id, ids): each document in one of the rounds, whose sizes are as the numbers in ``rounds``. Each round trains all weights if ``whole``, as in op8_attention_lm;
    else the last of several leaves embeddings and attention as they are."""
    spark = coded.sparkSession
    h = F.xxhash64("ids", "doc_id")
    share = F.pmod(h, F.lit(sum(rounds)))
    turn = F.lit(0)
    for edge in np.cumsum(rounds)[:-1].tolist():
        turn = turn + (share >= edge).cast("int")
    rows = coded.where(F.length("ids") > 0).select("doc_id", "ids", F.shiftrightunsigned(h, 20).alias("_h"), turn.alias("turn"))
    # a row for each round
    tokens = {r["turn"]: r["n"] // 2 for r in rows.groupBy("turn").agg(F.sum(F.length("ids").cast("long")).alias("n")).collect()}
    model = start(classes)
    total = sum(tokens.values())
    if not total:
        return model
    again = math.ceil(least_tokens / total) - 1
    for wanted in [[t] for t in sorted(tokens)] + [sorted(tokens)] * again:
        inner = whole or len(rounds) == 1 or wanted != [len(rounds) - 1]
        n = sum(tokens[t] for t in wanted)
        replicas = math.ceil(n / replica_tokens)
        tasks = min(replicas, MOST_TASKS)
        shared = spark.sparkContext.broadcast((flat(model), classes, rate, inner))
        own = rows.where(F.col("turn").isin(wanted)).withColumn("replica", F.pmod("_h", F.lit(replicas)))
        sorted_ = own.repartitionById(tasks, F.pmod("replica", F.lit(tasks)).cast("int")).sortWithinPartitions("replica", "doc_id", "ids").select("replica", "ids")
        learnt = sorted_.mapInArrow(learner(shared), WEIGHTS).repartition("chunk").mapInArrow(averaged, WEIGHTS)
        # as many bytes as the model has, whatever the data
        got = {r["chunk"]: r["weights"] for r in learnt.collect()}
        model = unflat(np.concatenate([np.frombuffer(got[c], np.float32) for c in sorted(got)]), classes)
        shared.destroy()
    return model


def scored(coded: DataFrame, model: dict[str, np.ndarray], classes: Classes) -> DataFrame:
    """doc_id, n_tokens, nll, mean_nll of each row."""
    shared = coded.sparkSession.sparkContext.broadcast((flat(model), classes))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        weights, classes = shared.value
        scorer = Scorer(unflat(weights, classes), classes)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = unpack(part.column(1))
                n = np.array([len(x) for x in ids], np.int64)
                nll = scorer.score(ids)
                mean = [float(s) / int(k) if k else None for s, k in zip(nll, n, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(nll), pa.array(mean, pa.float64())], ["doc_id", "n_tokens", "nll", "mean_nll"])

    return coded.select("doc_id", "ids").mapInArrow(score, "doc_id long, n_tokens long, nll double, mean_nll double")


def op8_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a model trained on the same corpus."""
    coded = written(encoded(load(spark, sf_dir, "documents")), "ids")
    classes = Classes(counted(coded))
    return scored(coded, fit(coded, classes, whole=True), classes)


QUERIES = {"op8_attention_lm": op8_attention_lm}
SQL: dict[str, str] = {}
