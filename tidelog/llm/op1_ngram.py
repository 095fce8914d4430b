"""Language-model scores from an Elias-Fano n-gram trie, sharded by the last context word.

Texts become blocks of token places and word hashes. The words of all blocks meet once, in shards of words: these count
them and give each a number, small for common ones, and the blocks are written again with numbers in place of hashes.
Each block then sends every shard of windows one message: its distinct windows there, with their training counts. A shard
sums the counts of all messages, builds its trie, maps it from a file, looks up each of its distinct windows once and
answers the messages. So one exchange both counts and looks up, repeats within a block travel once, and no part of the model
is ever on the driver or broadcast.
Shards grow in number with the tokens; blocks can be enlarged with ``block_bytes`` on larger inputs.

A window of three words belongs to the shard of its middle word. Middle words with over a quarter of a shard's tokens
are hot: their windows are dealt to all shards by the word before as well, and the two-word windows by the word after.
Pairs of words stay whole so; before how many words a hot word stands is summed over the shards, one row for each hot
word and shard.

The model interpolates by Witten and Bell: p(w | h) = (c(hw) + T(h) p(w | shorter h)) / (c(h) + T(h)), T the number
of distinct successors, down to p(w) = (c + 1) / (N + V + 1), where all unknown words share one place. Stored
probabilities are quantised to 65,534 steps of log10, 0.0002 apart.

A null text counts as empty (its end is scored); a null id trains (its crc32 is that of the empty text); repeated
rows count and are scored each; an empty table gives no row; further columns are ignored. Words are told apart by
64-bit hashes. With no training rows every probability is 1/(0 + 0 + 1)."""

from __future__ import annotations

import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, Words, blocks, documents, dropped, freed, mix, remainder, text_of, written
from .eliasfano import COUNT, Trie, load, quantise, save, value

ORDER = 3
BLOCK, STEP = 8 << 20, 2 << 20
#: Words of blocks to a shard of words, tokens to a shard of windows; more than 1 / HOT of these make a word hot.
SHARD_WORDS, SHARD_TOKENS, HOT = 2_000_000, 1_000_000, 4
BEGIN, END = np.uint64(1), np.uint64(2)


def _squeeze(a: np.ndarray) -> bytes:
    """The array's bytes, all first ones first, compressed; numbers of eight bytes as four where all fit."""
    if a.dtype.itemsize == 8 and (not len(a) or int(a.max()) < 1 << 32):
        a = a.astype("<u4")
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T)
    return bytes([a.itemsize]) + pa.compress(planes, "zstd", asbytes=True)


def _spread(data: bytes, n: int, kind: str) -> np.ndarray:
    size = data[0]
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(pa.py_buffer(data)[1:], size * n, "zstd"), np.uint8).reshape(size, n)
    out = np.ascontiguousarray(planes.T).view(f"<u{size}").ravel()
    return out if out.dtype == np.dtype(kind) else out.astype(kind)


_LONGS = pa.list_(pa.int64())
_ROWS = [("block", pa.int64()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("doc_id", _LONGS), ("held", pa.list_(pa.bool_())), ("lens", pa.list_(pa.int32()))]
_HASHED = pa.schema([*_ROWS, ("hashes", pa.binary()), ("tokens", pa.binary())])
_NUMBERED = pa.schema([*_ROWS, ("words", pa.binary()), ("tokens", pa.binary())])
_DDL = "block long, n_tokens long, n_words long, doc_id array<long>, held array<boolean>, lens array<int>, "


def to_blocks(docs: DataFrame, held: str, block_bytes: int = BLOCK) -> DataFrame:
    """(block, n_tokens, n_words, doc_id[], held[], lens[], hashes, tokens) of (doc_id, text, held): all tokens, with an end to
    each document, as places among the hashes of the block's words and of END and BEGIN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for some in blocks(batch, "text", block_bytes):
                hashes, lens = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for part in blocks(some, "text", min(STEP, block_bytes)):
                    words = Words(part.column("text"), LOWER)
                    hashes.append(words.hashes())
                    lens.append(np.diff(words.first))
                vocab, index = np.unique(np.concatenate(hashes), return_inverse=True)
                lens = np.concatenate(lens) + 1
                tokens = np.full(int(lens.sum()), len(vocab), "<u4")
                inner = np.ones(len(tokens), bool)
                inner[np.cumsum(lens) - 1] = False
                tokens[inner] = index
                vocab = np.concatenate([vocab, np.array([END, BEGIN], np.uint64)])
                row = [[TaskContext.get().partitionId() << 32 | n], [len(tokens)], [len(vocab)], [some.column("doc_id").to_pylist()], [some.column("held").to_pylist()], [lens.tolist()], [vocab.tobytes()], [_squeeze(tokens)]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _HASHED)], _HASHED)
                n += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.expr(held).alias("held"))
    return rows.mapInArrow(run, _DDL + "hashes binary, tokens binary")


def _of_words(row: dict, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hashed block's hashes, and its words in the order of their shards, with where each shard's begin."""
    hashes = np.frombuffer(row["hashes"], np.uint64)
    shard = (hashes >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return hashes, order, np.searchsorted(shard[order], np.arange(shards + 1))


def _train(row: dict) -> np.ndarray:
    return ~np.repeat(np.array(row["held"], bool), np.array(row["lens"], np.int64))


def _word_messages(shards: int):
    kinds, names = [pa.int32(), pa.int64(), pa.int64(), pa.binary()], ["shard", "block", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, order, bounds = _of_words(row, shards)
                count = np.bincount(_spread(row["tokens"], row["n_tokens"], "<u4")[_train(row)], minlength=len(hashes))
                count[-1] = len(row["held"]) - sum(row["held"])  # BEGIN
                out = []
                for s in range(shards):
                    own = order[bounds[s] : bounds[s + 1]]
                    if len(own):
                        out.append((s, row["block"], len(own), hashes[own].tobytes() + _squeeze(count[own].astype("<u8"))))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


#: Rows of answers that are none: all training tokens and distinct words of a shard; a hot word and its distinct successors.
_TOTALS, _HOT = -1, -2


def _word_answers(shards: int, hot_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = table.select(["block", "n", "body"]).to_pylist()
        hashes = [np.frombuffer(r["body"], np.uint64, r["n"]) for r in rows]
        words, which = np.unique(np.concatenate(hashes), return_inverse=True)
        count = np.zeros(len(words), np.int64)
        np.add.at(count, which, np.concatenate([_spread(r["body"][8 * r["n"] :], r["n"], "<u8") for r in rows]).astype(np.int64))
        number = np.empty(len(words), np.int64)
        number[np.argsort(-count, kind="stable")] = np.arange(len(words)) * shards + shard  # common words have small numbers
        real = count[words != BEGIN]
        begin = number[words == BEGIN].tolist()
        out: list[tuple] = [(_TOTALS, shard, int(real.sum()), int((real > 0).sum()), b"")]
        out += [(_HOT, shard, int(number[w]), int(count[w]), b"") for w in np.flatnonzero(count > hot_tokens)]
        for r, own in zip(rows, np.split(which, np.cumsum([len(x) for x in hashes])[:-1])):
            out.append((r["block"], shard, r["n"], begin[0] if begin else -1, _squeeze(np.concatenate([number[own], count[own]]).astype("<u8"))))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["block", "shard", "n", "m", "body"])

    return run


def _numbered(shards: int):
    """Blocks with their words in the order of numbers: numbers (differences) and counts, and tokens as places among these."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        _, order, bounds = _of_words(row, shards)
        both = np.empty((2, row["n_words"]), np.int64)
        for x in right.to_pylist():
            s = x["shard"]
            both[:, order[bounds[s] : bounds[s + 1]]] = _spread(x["body"], 2 * x["n"], "<u8").reshape(2, -1).astype(np.int64)
        by = np.argsort(both[0])
        place = np.empty(len(by), np.uint32)
        place[by] = np.arange(len(by))
        body = np.concatenate([np.diff(both[0, by], prepend=0), both[1, by], [place[-1]]]).astype("<u8")
        tokens = place[_spread(row["tokens"], row["n_tokens"], "<u4")]
        values = [*([row[n]] for n, _ in _ROWS), [_squeeze(body)], [_squeeze(tokens.astype("<u4"))]]
        return pa.table([pa.array(x, f.type) for x, f in zip(values, _NUMBERED)], schema=_NUMBERED)

    return run


def numbered(docs: DataFrame, held: str, block_bytes: int, shard_words: int, shard_tokens: int) -> tuple[DataFrame, int, int, int, np.ndarray]:
    """The written blocks with numbers, all tokens, training tokens and distinct words, and the hot words' numbers."""
    table = written(to_blocks(docs, held, block_bytes), "op1-hashed", "none")
    n, words = table.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    shards = max(8, -(-words // shard_words))
    messages = table.mapInArrow(_word_messages(shards), "shard int, block long, n long, body binary")
    answers = written(messages.groupBy("shard").applyInArrow(_word_answers(shards, shard_tokens // HOT), "block long, shard int, n long, m long, body binary"), "op1-numbers", "none")
    total, kinds = answers.where(F.col("block") == _TOTALS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("m"), F.lit(0))).first()
    hot = sorted(r[0] for r in answers.where(F.col("block") == _HOT).select("n").collect())  # at most HOT for each shard of windows
    pairs = table.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    out = written(pairs.applyInArrow(_numbered(shards), _DDL + "words binary, tokens binary"), "op1-blocks", "none")
    for x in (table, answers):
        dropped(x)
    return out, n, total, kinds, np.array(hot, np.int64)


def _known(hashes: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which hashes are among the sorted ones."""
    if not len(sorted_):
        return np.zeros(len(hashes), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)] == hashes


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether one of the columns changes at a row; the first row counts."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


class Block:
    """A block's words by their numbers, and its distinct windows of three and two words in the order of their shards: the
    asking and the reading side derive the same."""

    def __init__(self, row: dict, order: int, shards: int, hot: np.ndarray):
        size = row["n_words"]
        body = _spread(row["words"], 2 * size + 1, "<u8").astype(np.int64)
        self.numbers, self.known, begin = np.cumsum(body[:size]), body[size : 2 * size], int(body[-1])
        self.lens = np.array(row["lens"], np.int64)
        word = _spread(row["tokens"], row["n_tokens"], "<u4").astype(np.int32)
        start = np.cumsum(self.lens) - self.lens
        last = np.concatenate([[begin], word[:-1]]).astype(np.int32)[: len(word)]
        last[start] = begin
        before = np.concatenate([[begin], last[:-1]]).astype(np.int32)[: len(word)]
        before[start] = begin
        if order == 2:
            before[:] = begin
        self.word = word
        mixed = mix(self.numbers.astype(np.uint64))
        home = (mixed % np.uint64(shards)).astype(np.int32)
        self.hot = _known(self.numbers, hot)

        def far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """The shard of a window of the words a and b: that of a, unless a is hot."""
            out = home[a]
            on = np.flatnonzero(self.hot[a])
            out[on] = (mix(mixed[a[on]] * np.uint64(3) ^ mixed[b[on]]) % np.uint64(shards)).astype(np.int32)
            return out

        key, pair = np.unique(last.astype(np.int64) * size + before, return_inverse=True)
        self.pair_l, self.pair_b = (key // size).astype(np.int32), (key % size).astype(np.int32)
        pair_shard = far(self.pair_l, self.pair_b)
        del last, before
        key, self.tri_of = np.unique(pair.astype(np.int64) * size + word, return_inverse=True)
        del pair
        self.tri_pair, self.tri_w = (key // size).astype(np.int32), (key % size).astype(np.int32)
        self.count = np.bincount(self.tri_of[_train(row)], minlength=len(key)).astype(np.uint32)
        key, self.two_of = np.unique(self.pair_l[self.tri_pair].astype(np.int64) * size + self.tri_w, return_inverse=True)
        self.two_l, self.two_w = (key // size).astype(np.int32), (key % size).astype(np.int32)
        self.two_count = np.bincount(self.two_of, self.count, len(key)).astype(np.uint32)
        two_shard = far(self.two_l, self.two_w)
        self.tri, self.tri_bounds = self._dealt(pair_shard[self.tri_pair], shards)
        self.pair, self.pair_bounds = self._dealt(pair_shard, shards)
        cold = ~self.hot[self.two_l]
        self.cold, self.cold_bounds = self._dealt(two_shard, shards, np.flatnonzero(cold))
        self.warm, self.warm_bounds = self._dealt(two_shard, shards, np.flatnonzero(~cold))

    @staticmethod
    def _dealt(shard: np.ndarray, shards: int, rows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The rows in order of shards, and where each shard's begin."""
        shard = shard.astype(np.uint16) if shards <= 1 << 16 else shard  # these are sorted by their bytes
        order = np.argsort(shard if rows is None else shard[rows], kind="stable")
        order = order if rows is None else rows[order]
        return order, np.searchsorted(shard[order], np.arange(shards + 1))

    def of(self, name: str, shard: int) -> np.ndarray:
        bounds = getattr(self, f"{name}_bounds")
        return getattr(self, name)[bounds[shard] : bounds[shard + 1]]


def _messages(order: int, shards: int, hot: np.ndarray):
    kinds = [pa.int32(), *[pa.int64()] * 3, pa.binary()]
    names = ["shard", "block", "n_tri", "n_two", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row, order, shards, hot)
                out: list[tuple] = []
                for s in range(shards):
                    tri, two = b.of("tri", s), b.of("warm", s)
                    if not len(tri) and not len(two):
                        continue
                    pair = b.tri_pair[tri]
                    rise = lambda x: np.diff(b.numbers[x], prepend=0)  # noqa: B023, E731
                    parts = [rise(b.pair_l[pair]), b.numbers[b.pair_b[pair]], b.numbers[b.tri_w[tri]], b.count[tri], rise(b.two_l[two]), b.numbers[b.two_w[two]], b.two_count[two]]
                    out.append((s, row["block"], len(tri), len(two), _squeeze(np.concatenate([x.astype("<u8") for x in parts]))))
                    if len(out) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

    return run


def _answers(hot: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        messages = table.select(["block", "n_tri", "n_two", "body"]).to_pylist()
        del table

        def parts(m: dict) -> list[np.ndarray]:
            sizes = [m["n_tri"]] * 4 + [m["n_two"]] * 3
            p = np.split(_spread(m["body"], sum(sizes), "<u8").astype(np.int64), np.cumsum(sizes)[:-1])
            p[0], p[4] = np.cumsum(p[0]), np.cumsum(p[4])
            return p

        own, counts, kinds = [], [], []
        for m in messages:
            p = parts(m)
            new = _starts(p[0])
            some, local = np.unique(np.concatenate([p[0][new], p[1], p[2], p[4], p[5]]), return_inverse=True)
            at = np.cumsum([int(new.sum()), len(p[1]), len(p[2]), len(p[4])])
            l, *others = np.split(local.astype(np.int32), at)
            own.append([l[np.cumsum(new) - 1], *others])
            kinds.append(some)
            counts.append((p[3].astype(np.uint32), p[6].astype(np.uint32)))
        words = np.sort(np.concatenate(kinds))
        words = words[_starts(words)]
        is_hot = _known(words, hot)
        for k, some in enumerate(kinds):
            rank = np.searchsorted(words, some).astype(np.int32)
            own[k] = [rank[x] for x in own[k]]
        del kinds
        # The distinct windows of all messages, each built from and looked up once, and where each message's are among them.
        n, (l, u, w, hot_l, hot_w) = max(len(words), 1), (np.concatenate(x).astype(np.int64) for x in zip(*own))
        seen3, seen2 = (np.concatenate(x) for x in zip(*counts))
        del own, counts
        key, two_of = np.unique(np.concatenate([l * n + w, hot_l * n + hot_w]), return_inverse=True)
        first, second = key // n, key % n
        warm_of, two_of = two_of[len(l) :], two_of[: len(l)]
        pair, pair_of = np.unique(l * n + u, return_inverse=True)
        del l, u, w, hot_l, hot_w
        pair_l, pair_u = pair // n, pair % n
        tri, tri_of = np.unique(pair_of * len(key) + two_of, return_inverse=True)
        tri_pair, tri_two = tri // max(len(key), 1), tri % max(len(key), 1)
        count = np.bincount(tri_of, seen3, len(tri)).astype(np.int64)
        on, of = np.flatnonzero(count), tri_pair[count > 0]
        warm = np.bincount(warm_of, seen2, len(key)).astype(np.int64)
        hot_on = np.flatnonzero(warm)
        arrays = Trie.build(words, is_hot, (pair_l[of], pair_u[of], second[tri_two[on]], count[on]), (first[hot_on], second[hot_on], warm[hot_on]))
        del key, pair, tri, on, of, hot_on, seen3, seen2
        rows: list[tuple] = [(_HOT, shard, int(words[w]), int(n), b"") for w, n in zip(arrays["hot"], arrays["kinds"]) if n]
        path = os.path.join(tempfile.gettempdir(), f"trie-{uuid.uuid4().hex}")
        try:
            save(path, arrays)
            del arrays, words
            trie = Trie(load(path))
            place, begin = trie.two.find(first, second)
            after, rest = trie.after_pair(tri_pair, pair_l, pair_u, tri_two, place, begin)
            share, cold, less = trie.shares(place), ~is_hot[first], trie.a["words.r"][first]
            tri_at = warm_at = 0
            for m in messages:
                own3, own2 = slice(tri_at, tri_at + m["n_tri"]), slice(warm_at, warm_at + m["n_two"])
                tri_at, warm_at = own3.stop, own2.stop
                pairs = pair_of[own3]
                # Distinct words after a word, in order: the block has those after words that are not hot in this order.
                two = np.sort(two_of[own3])
                two = two[_starts(two)]
                two = two[cold[two]]
                each = [after[tri_of[own3]], rest[pairs[_starts(pairs)]], share[two], less[two], share[warm_of[own2]]]
                rows.append((m["block"], shard, sum(map(len, each)), 0, _squeeze(np.concatenate(each).astype("<u2"))))
        finally:
            if os.path.exists(path):
                os.remove(path)
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["block", "shard", "n", "m", "body"])

    return run


_OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(order: int, shards: int, total: int, kinds: int, hot: np.ndarray, after_hot: np.ndarray):
    """after_hot: distinct successors of each of the sorted hot words."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        b = Block(row, order, shards, hot)
        c = b.known
        three, rest3 = np.zeros(len(b.tri_w)), np.ones(len(b.pair_l))
        two, rest2 = np.zeros(len(b.two_w)), np.ones(len(b.two_w))
        for x in right.to_pylist():
            at = [b.of(name, x["shard"]) for name in ("tri", "pair", "cold", "cold", "warm")]
            p = np.split(_spread(x["body"], x["n"], "<u2"), np.cumsum([len(k) for k in at])[:-1])
            three[at[0]], rest3[at[1]], two[at[2]], rest2[at[3]], two[at[4]] = (value(k) for k in p)
        if len(b.warm):  # counts of hot words' successors
            l = b.two_l[b.warm]
            seen = after_hot[np.searchsorted(hot, b.numbers[l])].astype(float)
            whole = np.maximum(c[l] + seen, 1)
            two[b.warm], rest2[b.warm] = two[b.warm] / COUNT / whole, np.where(c[l] > 0, seen / whole, 1.0)
        docs, of = len(b.lens), np.repeat(np.arange(len(b.lens)), b.lens)
        unigram = (c + 1) / (total + (kinds + 1))
        p2 = two + rest2 * unigram[b.two_w]
        p3 = p2[b.two_of] if order == 2 else three + rest3[b.tri_pair] * p2[b.two_of]
        sums = lambda each: np.bincount(of, each, docs)
        columns = [pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(b.lens), pa.array(sums((c > 0)[b.word]).astype(np.int64)), pa.array(np.full(docs, total, np.int64)), pa.array(sums(np.log10(unigram)[b.word])), pa.array(sums(np.log10(p3)[b.tri_of]))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _asked(table: DataFrame, order: int, shards: int, hot: np.ndarray) -> DataFrame:
    messages = table.mapInArrow(_messages(order, shards, hot), "shard int, block long, n_tri long, n_two long, body binary")
    return written(messages.groupBy("shard").applyInArrow(_answers(hot), "block long, shard int, n long, m long, body binary"), "op1-answers", "none")


def score(docs: DataFrame, held: str, order: int = ORDER, block_bytes: int = BLOCK, shard_tokens: int = SHARD_TOKENS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Scores of all documents by a model of those for which the SQL expression ``held`` is false."""
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    table, n, total, kinds, hot = numbered(docs, held, block_bytes, shard_words, shard_tokens)
    freed(docs.sparkSession)  # the shuffle files of what is written
    shards = max(8, -(-n // shard_tokens))
    answers = _asked(table, order, shards, hot)
    freed(docs.sparkSession)
    after = {r[0]: r[1] for r in answers.where(F.col("block") == _HOT).groupBy("n").agg(F.sum("m")).collect()}  # a row for each hot word
    after_hot = np.array([after.get(h, 0) for h in hot.tolist()], np.int64)
    pairs = table.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))
    return pairs.applyInArrow(_scores(order, shards, total, kinds, hot, after_hot), _OUT)


def crc_text(x) -> int:
    return zlib.crc32(str(x).encode()) if x is not None else 0


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("_held", remainder("doc_id", 7) == 2)
    return score(docs, "_held")
