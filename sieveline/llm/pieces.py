"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

The lattice of a text has the characters' ends as nodes and the pieces as edges. Forward filtering sums the weights of
all paths to each node; backward sampling walks from the end, drawing each piece with its share of the node's sum, so
a segmentation comes with its posterior probability. Draws are hashes of (seed, row key, place in the row): the same
row always gets the same segmentation, wherever and however often it runs.

No piece has a space mark after another character, so the lattice factors at space marks (and at newlines, which are
no piece's character): filtering is done once for each distinct unit of a group of texts, position by position for
all units together, and sampling piece by piece for all occurrences together. A text beyond GROUP characters is taken
in slices, cut at spaces; only a unit beyond UNIT characters is cut itself, so there alone the posterior is that of
its parts.

The model holds merge ranks r, no probabilities; by Zipf's law a piece weighs (r + 2) ** -alpha. A lone space mark, which has
no rank, counts as the last; runs of marks, which the model matches before merging, are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import mix, prepare

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = -20.0  #: log weight of a character that only its bytes can write
GROUP = 500_000  #: characters of text filtered and sampled at a time, and of a slice of a longer text
UNIT = 4096  #: a longer run without a space is taken in parts of so many characters, which no piece crosses
OUT = 2_000_000  #: characters of the texts of a batch that is given back, beyond one text

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD1B54A32D192ED03)


def vocabulary(model: str = MODEL) -> list[tuple[str, float, bool]]:
    """(piece, score, is_byte) by id, read on the driver; its size is the tokenizer's, whatever the corpus."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    return [("" if sp.is_control(i) or sp.is_unknown(i) else sp.id_to_piece(i), sp.get_score(i), sp.is_byte(i)) for i in ids]


class Lattice:
    """The vocabulary as a trie in arrays, and filtering and sampling of many units at once."""

    def __init__(self, vocab: list[tuple[str, float, bool]], alpha: float):
        rank = {p: (i, -alpha * np.log(2.0 - max(s, -len(vocab)))) for i, (p, s, byte) in enumerate(vocab) if p and not byte and (s > -1e8 or p == MARK)}
        if any(MARK in p[1:] or "\n" in p for p in rank):
            raise ValueError("a piece crosses a space mark or holds a newline: the lattice doesn't factor")
        self.raw = [bytes([int(p[1:-1], 16)]) if byte else p.replace(MARK, " ").encode() for p, _, byte in vocab]
        self.base = len(vocab)  # above: base + code point, for a character that only bytes write
        self.byte = np.full(256, -1, np.int32)
        for i, (p, _, byte) in enumerate(vocab):
            if byte:
                self.byte[int(p[1:-1], 16)] = i
        self.longest = max(map(len, rank))
        chars = sorted({c for p in rank for c in p})
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.kinds = len(chars) + 1
        nodes = {"": 0}
        for p in rank:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        edges = sorted((nodes[p[:-1]] * self.kinds + int(self.kind[ord(p[-1])]), i) for p, i in nodes.items() if p)
        self.keys, self.next = np.array([k for k, _ in edges], np.int64), np.array([i for _, i in edges], np.int32)
        self.piece, self.logw = np.full(len(nodes), -1, np.int32), np.zeros(len(nodes))
        for p, (i, w) in rank.items():
            self.piece[nodes[p]], self.logw[nodes[p]] = i, w
        self.mark = self.kind[ord(MARK)]
        self.root = np.zeros(self.kinds, np.int32)  # the first step, which every character takes; 0 is none
        some = self.keys < self.kinds
        self.root[self.keys[some]] = self.next[some]

    def _go(self, state: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * self.kinds + kind
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = self.keys[at] == key
        return self.next[at], ok

    def filter(self, spaced: list[str], bare: list[str]) -> dict[str, np.ndarray]:
        """Forward filtering of units (those after a space, then others); node (p, unit) is off[p] + rank[unit]."""
        flat = "".join([MARK + x for x in spaced]) + "".join(bare)
        code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter((*(len(x) + 1 for x in spaced), *map(len, bare)), np.int64, len(spaced) + len(bare))
        begin = np.cumsum(length) - length
        kind = self.kind[code]
        heads = np.zeros(len(code), bool)
        heads[begin[: len(spaced)]] = True
        kind[(kind == self.mark) & ~heads] = 0  # a literal mark is written as bytes
        order = np.argsort(-length, kind="stable")
        rank = np.empty(len(length), np.int64)
        rank[order] = np.arange(len(length))
        per = np.bincount(length, minlength=1)
        reach = len(length) - np.cumsum(per) + per  # units of length >= p
        off = np.cumsum(reach) - reach
        unit = np.repeat(np.arange(len(length)), length)
        pos = np.arange(len(code)) - begin[unit]
        left, mine = length[unit] - pos, rank[unit]
        i, state = np.arange(len(code)), self.root[kind]
        ok = state > 0
        found = []
        alone = ~ok | (self.piece[state] < 0)
        who = i[alone]
        found.append((who, np.ones(len(who), np.int64), (self.base + code[who]).astype(np.int32), np.full(len(who), UNKNOWN)))
        i, state, n = i[ok], state[ok], 1
        while len(i):
            real = self.piece[state] >= 0
            who = i[real]
            found.append((who, np.full(len(who), n, np.int64), self.piece[state[real]], self.logw[state[real]]))
            more = left[i] > n
            i, state = i[more], state[more]
            state, ok = self._go(state, kind[i + n])
            i, state, n = i[ok], state[ok], n + 1
        nodes = int(reach.sum())
        ends = [off[pos[w] + n] + mine[w] for w, n, _, _ in found]
        count = np.bincount(np.concatenate(ends), minlength=nodes) if ends else np.zeros(nodes, np.int64)
        at = np.cumsum(count) - count
        slot = at.copy()
        total = int(count.sum())
        src, back, piece, logw = np.empty(total, np.int64), np.empty(total, np.int32), np.empty(total, np.int32), np.empty(total)
        for (w, n, ids, weights), e in zip(found, ends):  # one candidate a node in each round
            k = slot[e]
            src[k], back[k], piece[k], logw[k] = off[pos[w]] + mine[w], n, ids, weights
            slot[e] += 1
        forward, cum = np.zeros(nodes), np.empty(total)
        for p in range(1, len(reach)):
            lo, hi = off[p], off[p] + reach[p]
            if lo == hi:
                break
            x = slice(at[lo], at[hi - 1] + count[hi - 1])
            v = forward[src[x]] + logw[x]
            first, sizes = at[lo:hi] - at[lo], count[lo:hi]
            most = np.maximum.reduceat(v, first)
            v = np.exp(v - np.repeat(most, sizes))
            live, j = np.flatnonzero(sizes > 1), 1
            while len(live):  # running sums of each node by itself, whatever else is in the group
                k = first[live] + j
                v[k] += v[k - 1]
                j += 1
                live = live[sizes[live] > j]
            whole = v[first + sizes - 1]
            forward[lo:hi] = most + np.log(whole)
            cum[x] = v / np.repeat(whole, sizes)
        return {"length": length, "rank": rank, "off": off, "at": at, "count": count, "cum": cum, "back": back, "piece": piece}

    def sample(self, t: dict[str, np.ndarray], units: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, number of pieces of each unit): a path of each unit, drawn from its end backwards."""
        live = np.arange(len(units))
        rank, pos, seed = t["rank"][units], t["length"][units], seeds
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        sizes = np.zeros(len(units), np.int64)
        while len(live):
            node = t["off"][pos] + rank
            pick, n = t["at"][node], t["count"][node]
            some = np.flatnonzero(n > 1)
            if len(some):
                u = (mix(seed[some] + np.array([len(steps) + 1], np.uint64) * _STEP) >> np.uint64(11)) * (1.0 / (1 << 53))
                c = pick[some]
                end = c + n[some]
                for hop in (16, 8, 4, 2, 1):
                    if hop <= self.longest:
                        ahead = np.minimum(c + hop, end - 1)
                        c = np.where((c + hop < end) & (t["cum"][ahead - 1] <= u), c + hop, c)
                pick[some] = c
            steps.append((live, t["piece"][pick]))
            sizes[live] += 1
            pos = pos - t["back"][pick]
            more = pos > 0
            live, rank, pos, seed = live[more], rank[more], pos[more], seed[more]
        ends = np.cumsum(sizes)
        ids = np.empty(ends[-1] if len(ends) else 0, np.int32)
        for j, (who, what) in enumerate(steps):
            ids[ends[who] - 1 - j] = what
        return ids, sizes

    def encode(self, texts: list[str], seeds: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); slices are taken in groups of about GROUP characters."""
        ids, sizes = [np.empty(0, np.int32)], np.zeros(len(texts), np.int64)
        group: list[tuple[int, int, bool, str]] = []  # row, units before, whether after a space, text
        held = 0

        def flush():
            nonlocal held
            if group:
                x, y = self._encode(group, seeds)
                ids.append(x)
                np.add.at(sizes, [g[0] for g in group], y)
                group.clear()
                held = 0

        for row, text in enumerate(texts):
            place = 0
            for spaced, part in slices(text):
                if held + len(part) > GROUP:
                    flush()
                group.append((row, place, spaced, part))
                held += len(part)
                if len(part) < len(text):
                    place += sum(1 for i, w in enumerate(part.split(" ")) for _ in units(w, spaced or i > 0))
        flush()
        return np.concatenate(ids), sizes

    def _encode(self, group: list[tuple[int, int, bool, str]], seed_of: list[int]) -> tuple[np.ndarray, np.ndarray]:
        heads: dict[str, int] = {}  # units after a space
        bare: dict[str, int] = {}
        lists = []
        for _, _, spaced, part in group:
            out = []
            for word in part.split(" "):
                if spaced and (word in heads or ("\n" not in word and len(word) <= UNIT)):
                    out.append(heads.setdefault(word, len(heads)))
                else:
                    out += [heads.setdefault(u, len(heads)) if after else -1 - bare.setdefault(u, len(bare)) for after, u in units(word, spaced)]
                spaced = True
            lists.append(out)
        seeds = [seed_of[row] for row, *_ in group]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        of = np.concatenate([np.array(x, np.int64) for x in lists])
        of = np.where(of < 0, len(heads) - 1 - of, of)
        ends = np.cumsum(sizes)
        place = np.arange(len(of)) - np.repeat(ends - sizes - np.array([g[1] for g in group], np.int64), sizes)
        where = mix(np.repeat(np.array(seeds, np.uint64), sizes) + _PLACE * place.astype(np.uint64))
        ids, of_unit = self.sample(self.filter(list(heads), list(bare)), of, where)
        row = np.repeat(np.repeat(np.arange(len(group)), sizes), of_unit)
        odd = ids >= self.base
        if odd.any():
            code = np.where(odd, ids - self.base, 0)
            wide = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
            stop = np.cumsum(wide)
            inner = np.arange(stop[-1]) - np.repeat(stop - wide, wide)
            code, size, odd, row = (np.repeat(v, wide) for v in (code, wide, odd, row))
            later = size - 1 - inner  # bytes of the character that follow this one
            lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size] + (code >> (6 * later))
            byte = np.where(inner == 0, lead, 0x80 + ((code >> (6 * later)) & 0x3F))
            ids = np.where(odd, self.byte[byte & 0xFF], np.repeat(ids, wide)).astype(np.int32)
        return ids, np.bincount(row, minlength=len(group)).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        """The text of a segmentation; the first space is the dummy prefix."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")

    def decodes(self, ids: np.ndarray, text: str) -> bool:
        """Whether ids decode to the text; a part of them is a list at a time."""
        raw = b"".join(b"".join(map(self.raw.__getitem__, ids[i : i + GROUP].tolist())) for i in range(0, len(ids), GROUP))
        return raw[1:].decode("utf-8", "surrogatepass") == text


def slices(text: str):
    """(whether it comes after a space, part): parts of at most about GROUP characters. A cut takes one space away,
    which the next part stands after; a run of GROUP characters without a space is cut inside."""
    at, spaced = 0, True
    while len(text) - at > GROUP:
        cut = text.rfind(" ", at, at + GROUP)
        if cut < 0:
            yield spaced, text[at : at + GROUP]
            at, spaced = at + GROUP, False
            if text[at] == " ":
                at, spaced = at + 1, True
        else:
            yield spaced, text[at:cut]
            at, spaced = cut + 1, True
    yield spaced, text[at:]


def units(word: str, after: bool):
    """(whether after a space, unit) of a run without spaces: newlines stand alone, and so do lines after the first
    and the parts after the first of a line beyond UNIT characters."""
    for j, line in enumerate(word.split("\n")):
        if j:
            yield False, "\n"
        if line or (after and not j):
            yield after and not j, line[:UNIT]
        for k in range(UNIT, len(line), UNIT):
            yield False, line[k : k + UNIT]


_lattices: dict[tuple, Lattice] = {}


def _lattice(shipped, alpha: float) -> Lattice:
    vocab = shipped.value
    key = (shipped.id if hasattr(shipped, "id") else id(vocab), len(vocab), alpha)
    if key not in _lattices:
        _lattices.clear()
        _lattices[key] = Lattice(vocab, alpha)
    return _lattices[key]


def row_seed(key, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}|{'null' if key is None else key}")


def encode(docs: DataFrame, key: str = "doc_id", keep: list[str] | None = None, model: str = MODEL, alpha: float = 1.0, seed: int = 1) -> DataFrame:
    """keep..., ids array<int>, lossless boolean: a sampled segmentation of each text, decoded again and compared.

    - Null text: ids and lossless are null. Empty text: the dummy prefix alone.
    - Rows that share a key draw from the same numbers; equal text under equal keys gives equal ids.
    - Null keys hash as 'null'. Columns outside keep are ignored.
    - A very long text is filtered and sampled in slices; a task holds it, its ids and the decoded copy, once each.
    """
    spark = docs.sparkSession
    prepare(spark)
    keep = [key] if keep is None else keep
    shipped = spark.sparkContext.broadcast(vocabulary(model))

    def coded(lattice, batch):
        texts, keys = batch.column("sieve_text").to_pylist(), batch.column("sieve_key").to_pylist()
        ok = [i for i, t in enumerate(texts) if t is not None]
        ids, n = lattice.encode([texts[i] for i in ok], [row_seed(keys[i], seed) for i in ok])
        same = [None] * len(texts)
        for i, hi, m in zip(ok, np.cumsum(n).tolist(), n.tolist()):
            same[i] = lattice.decodes(ids[hi - m : hi], texts[i])
        sizes = np.zeros(len(texts), np.int64)
        sizes[ok] = n
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        mask = pa.array([t is None for t in texts])
        column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()), mask=mask)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column, pa.array(same, pa.bool_())], [*keep, "ids", "lossless"])

    def run(batches):
        lattice = _lattice(shipped, alpha)
        for batch in batches:
            size = np.cumsum(pc.fill_null(pc.utf8_length(batch.column("sieve_text")), 0).to_numpy(zero_copy_only=False))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(size, OUT + (size[i - 1] if i else 0), "right")))
                yield coded(lattice, batch.slice(i, j - i))
                i = j

    src = docs.select(*keep, F.col("text").cast("string").alias("sieve_text"), F.col(key).cast("string").alias("sieve_key"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*keep).schema) + "ids array<int>, lossless boolean"
    return src.mapInArrow(run, schema)


def decode(rows: DataFrame, keep: list[str], model: str = MODEL) -> DataFrame:
    """keep..., text: the text of each row's ids; null ids give null text, no ids the empty text."""
    spark = rows.sparkSession
    prepare(spark)
    shipped = spark.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        lattice = _lattice(shipped, 1.0)
        for batch in batches:
            texts = [None if x is None else lattice.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "text"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*keep).schema) + "text string"
    return rows.select(*dict.fromkeys([*keep, "ids"])).mapInArrow(run, schema)
