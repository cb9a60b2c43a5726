"""Token counts under a unigram tokenizer, without making the tokens.

Words (runs of anything but Unicode white space, with a word mark in front) are cut into pieces one by one, as such
tokenizers do, so a word's count never depends on its neighbours. An Aho-Corasick automaton names all vocabulary
pieces that end at each character; dynamic programming carries the best score and its number of pieces. Ties go to
the piece that starts first, since a later one replaces it only if it scores strictly better. A character that no
piece covers costs ten below the lowest score; a run of such characters counts its UTF-8 bytes if the vocabulary has
byte pieces, otherwise one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import slices, table

MARK = "▁"
#: The Unicode property White_Space (fixed values).
WORDS = re.compile("[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")
UNKNOWN_COST = 10.0
#: The vocabulary file; number and greatest length of the words whose counts one task remembers.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
REMEMBER, SHORT = 400_000, 64


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, in order of their ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter:
    """Counts pieces of words; ``pieces`` as from ``load_pieces``."""

    def __init__(self, pieces: list[tuple[str, float]]):
        special = re.compile("<0x[0-9A-F]{2}>|<unk>|<s>|</s>")
        self.bytes = sum(bool(re.fullmatch("<0x[0-9A-F]{2}>", p)) for p, _ in pieces) == 256
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_COST
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            if p and not special.fullmatch(p):
                self.automaton.add_word(p, (len(p), s))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.known: dict[str, tuple[int, float]] = {}

    def count(self, word: str) -> tuple[int, float]:
        """Number of pieces and score of one word, remembered."""
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            got = self.solve(MARK + word)
            if len(word) <= SHORT:
                self.known[word] = got
        return got

    def solve(self, text: str) -> tuple[int, float]:
        n = len(text)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text) if len(self.automaton) else ():
            ends[end].append(piece)
        score, pieces, tail = [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)  # tail: bytes of the unknown run that ends here
        for end in range(n):
            best = None
            alone = False
            for size, worth in sorted(ends[end], reverse=True):  # the longest starts first
                alone = alone or size == 1
                here = score[end + 1 - size] + worth
                if best is None or here > best:
                    best, start, fresh = here, end + 1 - size, 0
            if not alone and (best is None or score[end] + self.unknown > best):
                best, start, fresh = score[end] + self.unknown, end, len(text[end].encode())
            score[end + 1] = best
            if not fresh:
                pieces[end + 1], tail[end + 1] = pieces[start] + 1, 0
            elif self.bytes:
                pieces[end + 1], tail[end + 1] = pieces[start] + fresh, tail[start] + fresh
            else:
                pieces[end + 1], tail[end + 1] = pieces[start] + (not tail[start]), tail[start] + fresh
        return pieces[n], score[n]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(load_pieces(path))


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, best_score of every row of ``docs``. Null, empty and blank texts: zeros.

    The whole text counts, however long; other columns are ignored; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in slices(batches, "text", 8 << 20):
            rows = []
            for text in batch.column("text").to_pylist():
                found = [count(w) for w in WORDS.findall(text or "")]
                rows.append((len(found), sum(c for c, _ in found), float(sum(s for _, s in found))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c) for c in zip(*rows)]], ["doc_id", "n_words", "n_tokens", "best_score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_words long, n_tokens long, best_score double")


def op4_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
