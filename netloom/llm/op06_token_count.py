"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary piece that ends at a character; dynamic programming carries the
best score and the piece count of the best segmentation up to there, no back pointers and no pieces. Ties fall as they
do in the tokenizer library: of equal scores the segmentation found first stays, that is, the one with the longest last
piece. A character that no piece covers alone may also stand for itself, at the lowest score less a penalty, and counts
as its UTF-8 bytes. Spaces become the mark U+2581, and one stands before a text that is not empty.

Where the scores are whole numbers (sums are exact) and no piece has the mark after another character, every
segmentation breaks before each such mark, so counts of such stretches add up and are remembered for repeated words, a
bounded number of them. Otherwise the whole text is one stretch. Texts are read whole in one pass; nothing is shuffled.

Defined cases: null and empty texts have 0 tokens; repeated rows give repeated results; null identifiers are kept; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import re

import ahocorasick
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import Stages, col, slices, table

MARK = "▁"
PENALTY = 10.0
CACHE = 200_000
VOCABULARY = "piece_bpe_32k.model"


class Counter(dict):
    """Stretch -> number of pieces of its best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece and (piece not in self.automaton or score > self.automaton.get(piece)[1]):
                self.automaton.add_word(piece, (len(piece), score))
        if vocabulary:
            self.automaton.make_automaton()
        scores = [s for _, s in vocabulary]
        self.unknown = min(scores, default=0.0) - PENALTY
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.apart = all(s == int(s) for s in scores) and not any(inner.search(p) for p, _ in vocabulary)
        known = {p for p, _ in vocabulary if len(p) == 1}
        # a line break that is in no piece stands alone, too
        line = "" if any("\n" in p for p, _ in vocabulary) or "\n" in known else "\n"
        self.stretch = re.compile(f"{MARK}+[^{MARK}{line}]*|[^{MARK}{line}]+" + ("|\n" if line else ""))

    def viterbi(self, text: str) -> int:
        n = len(text)
        best: list[float | None] = [0.0] + [None] * n
        count = [0] * (n + 1)
        at, alone = 0, bytearray(n)
        found: list[tuple[int, tuple[int, float]]] = list(self.automaton.iter(text)) if len(self.automaton) else []
        for end, (size, _) in found:
            if size == 1:
                alone[end] = 1
        for i in range(n):
            # every piece that ends with character i, the longest first; then the character by itself
            while at < len(found) and found[at][0] == i:
                size, score = found[at][1]
                at += 1
                total = best[i + 1 - size] + score
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], count[i + 1] = total, count[i + 1 - size] + 1
            if not alone[i]:
                total = best[i] + self.unknown
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], count[i + 1] = total, count[i] + len(text[i].encode("utf-8", "surrogatepass"))
        return count[n]

    def __missing__(self, stretch: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self.viterbi(stretch)
        if len(stretch) < 64:
            self[stretch] = n
        return n

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        return sum(map(self.__getitem__, self.stretch.findall(text))) if self.apart else self.viterbi(text)


@functools.cache
def load(path: str) -> Counter:
    """The ordinary pieces of a vocabulary file with their scores; bytes, controls and the unknown piece are not matched."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return Counter([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))])


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row for each input row: doc_id, n_chars, n_tokens. path: the vocabulary file, at the same place everywhere."""
    Stages(df.sparkSession, "tokens")
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches):
        counter = load(path)
        for b in slices(batches):
            ts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or "") for t in ts], pa.int64()), pa.array([counter.tokens(t) for t in ts], pa.int64())], ["doc_id", "n_chars", "n_tokens"])

    rows = df.select(col(id_col).alias("doc_id"), F.col(f"`{text_col}`").cast("string"))
    return rows.mapInArrow(run, f"doc_id {rows.schema[0].dataType.simpleString()}, n_chars long, n_tokens long")


def op6_token_count(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
