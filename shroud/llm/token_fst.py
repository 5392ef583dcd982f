"""Token counts by a finite-state transducer compiled from a tokenizer's pieces.

A merge tokenizer's last token on every prefix is unique: it is the piece that
ends there and is compatible with the last token where it starts (a pair is
compatible if merging its concatenation gives back the pair).  The transducer
reads a character at a time.  Its state is the set of places at which a piece may
still be open: for each the node of the pieces' trie, the last token before that
place, and how many tokens the prefix counts more than the place.  Pieces have
bounded length, so states are finite; they and their transitions, each annotated
with the tokens it emits, are compiled when first reached and shared by their
value.  Characters outside the vocabulary emit their bytes and reset the state.

No piece holds a separator (the mark that stands for a space) behind another
character, so where one follows another character every state goes to the start
state.  A chunk of text is therefore a short state map: the part before its first
reset, a count, and the part after its last reset.  Chunk maps compose
associatively, so long texts are cut into chunks, counted apart and composed in
a tree-shaped scan; runs between two resets are counted once and remembered.

Defined results: null and empty texts have no bytes and no tokens; repeated rows
and null ids are kept row by row; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from operator import add
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroud.llm.common import batches, columns, texts

MARK = "▁"
CHUNK = 1 << 16
#: Marks and what follows them up to the next mark: a reset stands between two runs.
RUN = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Runs whose counts, and states whose transitions, a worker remembers; each starts anew when full.
REMEMBERED, STATES = 1_000_000, 300_000


class ChunkMap(NamedTuple):
    """What a chunk does to any state: ``head`` is read from the state that
    enters, then a reset; ``tokens`` are counted between resets; ``tail`` is read
    from the start state.  ``tail`` is None if the chunk holds no reset."""

    head: str
    tokens: int
    tail: str | None


class Transducer:
    def __init__(self, pieces: dict[str, float], single: dict[str, int] | None = None):
        """pieces: the mergeable pieces and their scores (higher merges first)."""
        self.score = pieces
        self.trie: list[dict[str, int]] = [{}]
        self.end: list[str | None] = [None]
        for piece in pieces:
            if self.merged(piece) != (piece,):
                continue  # never the result of merging
            node = 0
            for ch in piece:
                nxt = self.trie[node].get(ch)
                if nxt is None:
                    nxt = self.trie[node][ch] = len(self.trie)
                    self.trie.append({})
                    self.end.append(None)
                node = nxt
            self.end[node] = piece
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the separator behind another character")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.neighbours = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        self.known: dict[str, int] = {}
        self.words: dict[str, int] = {}  # by the run without its leading mark
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.steps: list[dict[str, tuple[int, int]]] = []
        self.intern(((0, None, 0),))

    def intern(self, state: tuple) -> int:
        at = self.ids.get(state)
        if at is None:
            at = self.ids[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
        return at

    def merged(self, text: str) -> tuple[str, ...]:
        """Plain merging of a short string: the best-scored neighbours first, the leftmost of equals."""
        parts, get = list(text), self.score.get
        scores = [get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while scores and (best := max(scores)) > -np.inf:
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = get(parts[i - 1] + parts[i], -np.inf)
            if i < len(scores):
                scores[i] = get(parts[i] + parts[i + 1], -np.inf)
        return tuple(parts)

    def compatible(self, a: str | None, b: str) -> bool:
        if a is None:
            return True
        pair = (a, b)
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) > REMEMBERED:
                self.pairs.clear()
            ok = self.pairs[pair] = self.merged(a + b) == pair
        return ok

    def step(self, at: int, ch: str) -> tuple[int, int]:
        """(next state, tokens emitted); compiled when first asked for."""
        done = self.steps[at].get(ch)
        if done is None:
            done = self.steps[at][ch] = self.compile(self.states[at], ch)
        return done

    def compile(self, state: tuple, ch: str) -> tuple[int, int]:
        """state: (trie node, last token before the place, tokens counted since the place)."""
        if ch not in self.trie[0]:
            return self.intern(((0, None, 0),)), len(ch.encode("utf-8", "replace"))
        moved, last, emitted = [], None, 0
        for node, before, since in state:
            nxt = self.trie[node].get(ch)
            if nxt is None:
                continue
            if not node and before is not None and before[-1] + ch not in self.neighbours:
                before = None  # no piece holds these neighbours: any two tokens may meet here
            piece = self.end[nxt]
            if piece is not None and last is None and self.compatible(before, piece):
                last, emitted = piece, 1 - since
            moved.append((nxt, before, since))
        if last is None:  # unreachable for a merge-closed vocabulary
            raise ValueError(f"no token ends at {ch!r}")
        return self.intern((*((n, b, s + emitted) for n, b, s in moved if self.trie[n]), (0, last, 0))), emitted

    def count(self, run: str) -> int:
        """Tokens of a run read from the start state."""
        n = self.known.get(run)
        if n is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            if len(self.states) > STATES:
                self.clear()
            n = at = 0
            for ch in run:
                at, more = self.step(at, ch)
                n += more
            self.known[run] = n
        return n

    def chunk_map(self, text: str) -> ChunkMap:
        head, *words = text.split(MARK)
        if not head and words:
            head = MARK + words.pop(0)
        if not all(words) or head == MARK:  # marks side by side
            runs = RUN.findall(text)
            return ChunkMap(runs[0], sum(map(self.text_count, runs[1:-1])), runs[-1]) if len(runs) > 1 else ChunkMap(text, 0, None)
        if not words:
            return ChunkMap(head, 0, None)
        tail, known = MARK + words.pop(), self.words
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words).difference(known):
            known[word] = self.text_count(MARK + word)
        return ChunkMap(head, sum(map(known.__getitem__, words)), tail)

    def text_count(self, text: str) -> int:
        """Tokens of a text read from the start state; neighbours that no piece holds part it."""
        total, start, neighbours = 0, 0, self.neighbours
        for end, pair in enumerate(map(add, text, text[1:]), 1):
            if pair not in neighbours:
                total += self.count(text[start:end])
                start = end
        return total + (self.count(text[start:]) if text else 0)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.tail is None:
            if b.tail is None:
                return self.chunk_map(a.head + b.head)
            front = self.chunk_map(a.head + b.head)
            if front.tail is None:
                return ChunkMap(front.head, b.tokens, b.tail)
            return ChunkMap(front.head, front.tokens + self.text_count(front.tail) + b.tokens, b.tail)
        seam = self.chunk_map(a.tail + b.head)
        if b.tail is None:
            return ChunkMap(a.head, a.tokens, seam.head) if seam.tail is None else ChunkMap(a.head, a.tokens + self.text_count(seam.head) + seam.tokens, seam.tail)
        mid = self.text_count(seam.head) + (seam.tokens + self.text_count(seam.tail) if seam.tail is not None else 0)
        return ChunkMap(a.head, a.tokens + mid + b.tokens, b.tail)

    def finish(self, m: ChunkMap) -> int:
        return self.text_count(m.head) + m.tokens + (self.text_count(m.tail) if m.tail is not None else 0)

    def count_text(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a text whose spaces are already marks, chunk by chunk."""
        if not text:
            return 0
        maps = [self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]
        while len(maps) > 1:  # one level of the scan
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.finish(maps[0])


@lru_cache(maxsize=2)
def load(path: str) -> Transducer:
    """Compile the transducer of a sentencepiece model of merge type with byte fallback."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Transducer(
        {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    )


def marked(text: str) -> str:
    """The model's normal form: a space in front, spaces as marks; empty stays empty."""
    return MARK + text.replace(" ", MARK) if text else ""


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` row by row."""
    rows = columns(docs, doc_id=id_col, text=text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = load(model_path)
        for batch in batches(parts):
            size, n = [], []
            for text in texts(batch.column(1)):
                size.append(len(text))
                n.append(machine.count_text(marked(text.decode("utf-8", "replace")), chunk))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
