"""Token counts under a unigram model of a public vocabulary, with trie-shared dynamic programming.

Pre-tokens are words without ASCII white space, each led by the vocabulary's space mark. A piece of rank r has log
probability -ln(r + 2) (Zipf's law over the public file's ranks, so nothing is trained); a character that is in no
piece costs one byte token for each of its UTF-8 bytes. The count of a pre-token is that of the segmentation with the
highest sum (ties: fewer tokens, then the longer last piece).

Documents are looked at in blocks. Arrow splits their texts and finds the block's distinct pre-tokens, which make up a
trie: a node holds the forward score and count of the best segmentation of its prefix, so pre-tokens that begin alike
share that work. The trie is made level by level, in arrays, from the sorted pre-tokens; a node looks for the pieces that
end at it in a second trie, of the pieces read backwards, while it goes up to the nodes that they begin at. Only as many
levels are kept as the longest piece has characters. Nothing is shuffled and no state outlives its block.

Null or blank texts have no tokens. Rows are independent, so repeated rows and ids just repeat. Other columns are ignored.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vigil.llm.common import trim

#: Nodes of the trie that `tokens` keeps before it is begun anew; bounds its memory.
TRIE_NODES = 600_000
#: Pre-tokens below which further levels of a block's trie aren't worth their arrays.
FEW = 100
#: Bytes of text whose distinct pre-tokens are counted together; a longer document is one block of its own.
BLOCK_BYTES = 8 << 20
#: Depth of that trie: the characters of a pre-token behind these are scored in continuation and leave no nodes.
LONGEST_SHARED = 48
MARK = "▁"
_UNKNOWN = -25.0
SCHEMA = "doc_id long, n_pretokens long, n_tokens long, log_score double"


def load_ranks(path: str) -> dict[str, int]:
    """Pieces of a sentencepiece model file and their ranks; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {model.id_to_piece(i): r for r, i in enumerate(ids)}


class PrefixTrie:
    def __init__(self, ranks: dict[str, int], limit: int = TRIE_NODES):
        # ends of pieces: the log probability of a piece, or 1.0 for what is only the end of some; so a search of the
        # pieces that end at a place stops as soon as no piece ends that way
        self.ends = {p[i:]: 1.0 for p in ranks for i in range(len(p))}
        self.ends |= {p: -math.log(r + 2) for p, r in ranks.items()}
        self.limit = limit
        self._begin()
        # the ends as a trie read backwards: the state of an end (0: of none) follows from that of the end without its
        # first character, and from this character
        names = sorted(self.ends, key=len)
        state = {e: i for i, e in enumerate(names, 1)} | {"": 0}
        self.value = np.array([1.0, *(self.ends[e] for e in names)])
        self.longest = max(map(len, names), default=1)
        self.single = np.zeros(sys.maxunicode + 1, np.int64)
        keys = np.array([state[e[1:]] << 21 | ord(e[0]) for e in names], np.int64)
        self.inner = np.zeros(len(names) + 1, bool)
        self.inner[keys >> 21] = True
        for e in names:
            if len(e) == 1:
                self.single[ord(e)] = state[e]
        by = np.argsort(keys)
        self.keys, self.after = np.append(keys[by], np.iinfo(np.int64).max), np.append(by + 1, 0)

    def _begin(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0.0]  # forward score of each node's prefix
        self.count = [0]
        self.terminal: dict[str, tuple[int, float]] = {}

    def _extend(self, text: str, best: list[float], count: list[int]) -> None:
        """Forward scores and counts of all prefixes of text that are longer than those known, from the shorter ones."""
        ends = self.ends.get
        for end in range(len(best), len(text) + 1):
            begin = end - 1
            top, n = -math.inf, 0
            s = ends(text[begin:end])
            if s is None or s > 0:
                n = len(text[begin].encode())
                top = best[begin] + _UNKNOWN * n
                n += count[begin]
            while s is not None:
                if s < 0:
                    s += best[begin]
                    if s > top or s == top and count[begin] < n:
                        top, n = s, count[begin] + 1
                begin -= 1
                s = ends(text[begin:end]) if begin >= 0 else None
            best.append(top)
            count.append(n)

    def tokens(self, pretoken: str) -> tuple[int, float]:
        """(tokens, score) of the best segmentation."""
        known = self.terminal.get(pretoken)
        if known is not None:
            return known
        text = MARK + pretoken
        best, count = [0.0], [0]
        if len(self.best) > self.limit:
            self._begin()
        node, child = 0, self.child
        for c in text:
            below = child.get((node, c))
            if below is None:
                break
            node = below
            best.append(self.best[node])
            count.append(self.count[node])
        shared = len(best)
        self._extend(text, best, count)
        for end in range(shared, min(len(best), LONGEST_SHARED + 1)):
            below = child[node, text[end - 1]] = len(self.best)
            self.best.append(best[end])
            self.count.append(count[end])
            node = below
        out = count[-1], best[-1]
        if len(text) <= LONGEST_SHARED:
            self.terminal[pretoken] = out
        return out

    def _level(self, levels: list, d: int) -> None:
        """Fill in the forward scores and counts of the nodes at depth d, whose parents and characters are known."""
        up, char, top, n = levels[d]
        state = self.single[char]
        _, _, best, count = levels[d - 1]
        odd = np.flatnonzero(self.value[state] > 0)  # no piece by itself
        size = 1 + (char[odd] > 0x7F) + (char[odd] > 0x7FF) + (char[odd] > 0xFFFF)
        top[odd] = best[up[odd]] + _UNKNOWN * size
        n[odd] = count[up[odd]] + size
        at = np.flatnonzero(state > 0)
        state, node = state[at], up[at]
        for begin in range(d - 1, -1, -1):
            score = self.value[state]
            piece = np.flatnonzero(score < 0)
            i, a = at[piece], node[piece]
            s, k = score[piece] + levels[begin][2][a], levels[begin][3][a] + 1
            better = (s > top[i]) | (s == top[i]) & (k <= n[i])
            top[i[better]], n[i[better]] = s[better], k[better]
            on = np.flatnonzero(self.inner[state])
            if not begin or not len(on):
                return
            up, char = levels[begin][:2]
            key = state[on] << 21 | char[node[on]]
            place = np.searchsorted(self.keys, key)
            some = self.keys[place] == key
            on = on[some]
            at, state, node = at[on], self.after[place[some]], up[node[on]]

    def tokens_of(self, pretokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and scores of the best segmentations of many pre-tokens; the same as `tokens` gives of each."""
        order = pc.array_sort_indices(pretokens)
        words = pretokens.take(order)
        chars = np.frombuffer(b"".join([w.encode("utf-32-le") for w in words.to_pylist()]), np.uint32).astype(np.int64)
        length = np.asarray(pc.utf8_length(words)).astype(np.int64) + 1  # with the mark
        begin = np.cumsum(length - 1) - length
        tokens, scores = np.zeros(len(words), np.int64), np.zeros(len(words))
        # of each level: its nodes' parents, last characters, forward scores and counts
        none = np.zeros(1, np.int64)
        levels: list = [(none, none, np.zeros(1), none)]
        alive, node, d = np.arange(len(words)), np.zeros(len(words), np.int64), 0
        while len(alive) >= FEW or d == 0 and len(alive):
            d += 1
            char = chars[begin[alive] + d - 1] if d > 1 else np.full(len(alive), ord(MARK), np.int64)
            new = np.append(True, (node[1:] != node[:-1]) | (char[1:] != char[:-1]))
            levels.append((node[new], char[new], np.full(int(new.sum()), -np.inf), np.zeros(int(new.sum()), np.int64)))
            node = np.cumsum(new) - 1
            self._level(levels, d)
            if d > self.longest:
                levels[d - self.longest - 1] = None
            whole = length[alive] == d
            scores[alive[whole]], tokens[alive[whole]] = levels[d][2][node[whole]], levels[d][3][node[whole]]
            alive, node = alive[~whole], node[~whole]
        for i, x in zip(alive.tolist(), node.tolist(), strict=True):
            best, count, low = [], [], max(0, d - self.longest)
            for y in range(d, low - 1, -1):
                best.insert(0, float(levels[y][2][x]))
                count.insert(0, int(levels[y][3][x]))
                x = levels[y][0][x]
            self._extend((MARK + words[i].as_py())[low:], best, count)
            scores[i], tokens[i] = best[-1], count[-1]
        back = np.empty(len(words), np.int64)
        back[np.asarray(order)] = np.arange(len(words))
        return tokens[back], scores[back]


_TRIES: dict[str, PrefixTrie] = {}


def _blocks(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in slices of about BLOCK_BYTES; a longer text is a slice of its own."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, side="right")))
        yield texts[i:j]
        i = j


def _count_block(trie: PrefixTrie, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens, tokens and score of each text; the trie is asked once for each distinct pre-token of them all."""
    words = pc.ascii_split_whitespace(texts)  # also gives an empty word beside white space at an end
    ids = words.flatten().dictionary_encode()
    n, s = trie.tokens_of(ids.dictionary)
    some = np.asarray(pc.binary_length(ids.dictionary)) > 0
    at = np.asarray(ids.indices)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.asarray(words.offsets)))
    # added up in text order, whatever the block, so a text's score is the same beside any others
    a, b, c = (np.bincount(doc, (v * some).astype(np.float64)[at], len(texts)) for v in (some, n, s))
    return a.astype(np.int64), b.astype(np.int64), c


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_pretokens, n_tokens and the log score of each document; vocabulary: a sentencepiece model file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _TRIES:
            _TRIES[vocabulary] = PrefixTrie(load_ranks(vocabulary))
        trie = _TRIES[vocabulary]
        for b in batches:
            made = [_count_block(trie, texts) for texts in _blocks(b.column(1).fill_null(""))]
            cols = [np.concatenate(c) for c in zip(*made, strict=True)] or [[], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True))], ["doc_id", "n_pretokens", "n_tokens", "log_score"])
        trim()

    from pyspark.sql import functions as F

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(count, SCHEMA)
