"""Token counts of whole texts by a public tokenizer."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.shared import whole_text

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Bytes handed to the encoder together (a piece more at most), and those of one piece of a long
#: text.
BATCH_BYTES = 1_000_000
PIECE_BYTES = 65_536
#: Lengths that a worker remembers.
KNOWN_LENGTHS = 300_000
# Fixed value: the vocabulary writes a blank as this character.
BLANK = "▁"


def model_path(name: str = MODEL) -> str:
    """Where the vocabulary lies on this machine; asked for in the task, on the executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Counts tokens by encoding parts that no token can span.

    A token holds blanks at its front only (checked when the vocabulary is loaded), so a text
    may be cut before a run of blanks that follows another character. The encoder puts one
    blank before whatever it gets; a later part therefore leaves out its first blank. Equal
    parts have equal lengths, which are remembered up to a bound.
    """

    def __init__(self, name: str = MODEL):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path(name))
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in pieces)
        self.known: dict[str, int] = {}

    def counts(self, texts: Iterable[str]) -> list[int]:
        """Tokens per text."""
        found: list[int] = []
        for batch in self.batches(texts, found):
            self._encode([(i, *self._parts(piece)) for i, piece in batch], found)
        return found

    def batches(self, texts: Iterable[str], found: list[int]) -> Iterator[list[tuple[int, str]]]:
        """Pieces with the number of their text, in batches of equal bytes: each is closed by the
        piece with which it reaches ``BATCH_BYTES``. ``found`` gets a 0 for each text."""
        batch: list[tuple[int, str]] = []
        size = 0
        for i, text in enumerate(texts):
            found.append(0)
            for piece, n_bytes in self._pieces(text):
                batch.append((i, piece))
                size += n_bytes
                if size >= BATCH_BYTES:
                    yield batch
                    batch, size = [], 0
        if batch:
            yield batch

    def _pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """The text in pieces of about ``PIECE_BYTES``, if it has blanks to cut at, with their bytes."""
        data = text.encode()
        if self.cuts and len(data) > PIECE_BYTES:
            data = text.replace(BLANK, " ").encode()
            start = 0
            while len(data) - start > PIECE_BYTES:
                cut = self._cut(data, start)
                if cut < 0:
                    break
                yield data[start:cut].decode(), cut - start
                start = cut + 1
            if start < len(data):
                yield data[start:].decode(), len(data) - start
        elif text:
            yield text, len(data)

    def _cut(self, data: bytes, start: int) -> int:
        """Place of a blank between two other parts, near the size of a piece; -1 if none. A blank's
        byte is part of no other character."""
        at = start + PIECE_BYTES
        while (at := data.find(b" ", at)) > 0 and at + 1 < len(data):
            if data[at - 1] != 32:
                return at
            at += 1
        return -1

    def _parts(self, piece: str) -> tuple[list[str], int]:
        """Parts that are encoded on their own, and tokens that are no part's."""
        if not self.cuts:
            return [piece], 0
        text = piece.replace(BLANK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" "), 0
        runs = re.findall(" *[^ ]+| +", text)
        parts = runs[:1] + [run[1:] for run in runs[1:]]
        return [p for p in parts if p], sum(not p for p in parts)  # one blank at the end is a token

    def _encode(self, batch: list[tuple[int, list[str], int]], found: list[int]) -> None:
        if len(self.known) > KNOWN_LENGTHS:
            self.known.clear()
        known = self.known
        new = list({p for _, parts, _ in batch for p in parts if p not in known})
        known.update(zip(new, map(len, self.model.encode(new, num_threads=1))) if new else ())
        for i, parts, extra in batch:
            found[i] += extra + sum(map(known.__getitem__, parts))


def token_counts(docs: DataFrame, model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit`` of every row's whole text.

    Neither begin, end nor added special tokens count; their strings inside a text are
    ordinary text. A null or empty text has 0 bytes and 0 tokens; a null id stays null; a
    repeated row is counted again; other columns are not read; an empty table gives no rows. Very
    long texts are encoded in pieces. Only lengths come back from Python.
    """
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            counts = encoder.counts(text.as_py() for text in batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array(counts, pa.int64()),
                    pa.array([n > limit for n in counts], pa.bool_()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(whole_text()).cast("bigint").alias("n_bytes"),
        whole_text().alias("text"),
    )
    return rows.mapInArrow(counted, schema)
