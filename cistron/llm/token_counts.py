"""Token counts of texts without encoding most of them.

A byte pair encoding merges neighbours only into strings of its vocabulary. So no merge crosses a place between two
characters that no piece has next to each other, and a text falls into pre-tokens at such places, each of which encodes by
itself. What can be proved from the vocabulary alone is proved once, on the driver:

* a character that stands in no piece but at its start begins a pre-token, one that stands in no piece but at its end
  finishes one; a mark of space begins one after any other character;
* which of the vocabulary's strings the library gives back as one token when they stand alone (not all: merges may take
  another way).

Pre-tokens among the latter count as one token; the rest is merged by the library, each different one of a batch once.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices

SPACE_MARK = "▁"
#: Characters of a text that are cut into pre-tokens at once; it goes on to the next mark of space.
WINDOW = 1 << 19
#: Counts of merged pre-tokens that a task keeps, of this length at most.
KEPT, KEPT_LENGTH = 1 << 17, 48
_SCHEMA = "id {id}, n_bytes long, n_tokens long, over_limit boolean, n_pretokens long, n_direct long"


@dataclass(frozen=True)
class Proof:
    """What the vocabulary guarantees."""

    model: bytes
    pattern: str
    direct: frozenset[str]
    alone: str

    @staticmethod
    def of(model_file: str) -> Proof:
        """From a SentencePiece model of type BPE that changes no text before encoding but for spaces."""
        import sentencepiece

        with open(model_file, "rb") as f:
            model = f.read()
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        inside = {c for p in pieces for c in p[1:]}
        before = {c for p in pieces for c in p[:-1]}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces):
            raise ValueError("a piece has a mark of space after another character")
        if sp.decode(sp.encode("  a  bé ﬁ ")) != "  a  bé ﬁ ":
            raise ValueError("the model changes texts before encoding")
        alone = next(chr(c) for c in range(0xE000, 0xF000) if chr(c) not in inside | before)
        more, first = _class(inside - {SPACE_MARK}), _class(before - {SPACE_MARK})
        # marks of space with what may follow; a character that may be followed, with it; any other character
        pattern = f"{SPACE_MARK}+{more}*|{first}{more}*|."
        direct = {p for p, n in zip(pieces, _counts(sp, alone, pieces), strict=True) if n == 1}
        shape = re.compile(pattern, re.DOTALL)
        return Proof(model, pattern, frozenset(p for p in direct if shape.fullmatch(p)), alone)


def _class(characters: set[str]) -> str:
    return "[" + "".join(re.escape(c) for c in sorted(characters)) + "]" if characters else "(?!)"


def _counts(sp, alone: str, pretokens: list[str]) -> list[int]:
    """Tokens of each pre-token when nothing stands beside it: after a character that is in no longer piece."""
    own = len(sp.encode(alone))
    return [len(x) - own for x in sp.encode([alone + p for p in pretokens], num_threads=1)]


class Counting:
    """Counts tokens of texts; remembers those of merged pre-tokens, up to a bound."""

    def __init__(self, proof: Proof) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proof.model)
        self.proof, self.shape = proof, re.compile(proof.pattern, re.DOTALL)
        self.border = re.compile(f"(?<=[^{SPACE_MARK}]){SPACE_MARK}")
        self.kept: dict[str, int] = {}

    def windows(self, text: str) -> Iterator[str]:
        """A text as the library sees it, in parts that begin with a mark of space."""
        text = SPACE_MARK + text.replace(" ", SPACE_MARK)
        at = 0
        while at < len(text):
            cut = self.border.search(text, at + WINDOW) if len(text) - at > WINDOW else None
            end = cut.start() if cut else len(text)
            yield text[at:end]
            at = end

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens, pre-tokens, and those of them that are one token."""
        if not text:
            return 0, 0, 0
        tokens = all_of = direct = 0
        for window in self.windows(text):
            rest = []
            for p, n in Counter(self.shape.findall(window)).items():
                all_of += n
                if p in self.proof.direct:
                    direct += n
                elif (known := self.kept.get(p)) is not None:
                    tokens += known * n
                else:
                    rest.append((p, n))
            if rest:
                if len(self.kept) > KEPT:
                    self.kept.clear()
                for (p, n), known in zip(rest, _counts(self.sp, self.proof.alone, [p for p, _ in rest]), strict=True):
                    tokens += known * n
                    if len(p) <= KEPT_LENGTH:
                        self.kept[p] = known
        return tokens + direct, all_of, direct


def count(docs: DataFrame, model_file: str, limit: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_pretokens, n_direct): tokens that the library gives each whole text.

    Without tokens for begin and end; strings of special tokens in a text are ordinary text. A null or empty text has no
    bytes and no tokens. n_direct: pre-tokens counted as one token without merging. A row is counted by itself, so a null
    or repeated id and columns of any name do no harm; nothing is shuffled, and only id and text are read. A long text
    is cut at a mark of space after each `WINDOW` characters; one without any is held whole. No rows give no rows.
    """
    proof = docs.sparkSession.sparkContext.broadcast(Proof.of(model_file))  # of the model's size, read on the driver
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    schema = _SCHEMA.format(id=rows.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(proof.value)
        for batch in batches:
            for part in slices(batch):
                sizes = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                found = [counting.count(t.as_py()) for t in part.column("text")]
                tokens, pretokens, direct = (pa.array([f[i] for f in found], pa.int64()) for i in range(3))
                over = pa.array([f[0] > limit for f in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, tokens, over, pretokens, direct], ["id", "n_bytes", "n_tokens", "over_limit", "n_pretokens", "n_direct"])
        release()

    return rows.mapInArrow(run, schema)
