"""What the operators on a SentencePiece model share: its bytes, its normaliser and where its texts may be cut."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

#: Stands for a space inside pieces.
SPACE = "▁"


def model_bytes(path: str | None = None) -> bytes:
    """The model file (about 0.5 MB), read on the driver and shipped with the job."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def processor(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def vocabulary(proc: sentencepiece.SentencePieceProcessor) -> dict[str, int]:
    """The pieces that text can match: no control, unknown, unused or byte pieces."""
    ids = range(proc.get_piece_size())
    return {proc.id_to_piece(i): i for i in ids if not (proc.is_control(i) or proc.is_unknown(i) or proc.is_byte(i) or proc.is_unused(i))}


def only_merges(proc: sentencepiece.SentencePieceProcessor, model: bytes) -> None:
    """Raises ValueError for a model that isn't a BPE, or with pieces of the user's, which are cut out before any merge."""
    kinds = proto.TrainerSpec
    if proto.ModelProto.FromString(model).trainer_spec.model_type != kinds.BPE:
        raise ValueError("only BPE models are supported")
    if any(p.type == proto.ModelProto.SentencePiece.USER_DEFINED for p in proto.ModelProto.FromString(model).pieces):
        raise ValueError("user-defined pieces aren't supported")


class Normaliser:
    """The model's normaliser, compiled from the settings in its file.

    Its first arc reads nothing and writes the space put before a text that isn't empty, if the model asks for it; `arcs`
    are the characters that it writes differently, all others pass; with `squeeze`, runs of spaces are one space and those
    at either end go. Raises ValueError for a model with a character map, or whose spaces follow words.
    """

    def __init__(self, model: bytes):
        whole = proto.ModelProto.FromString(model)
        spec = whole.normalizer_spec
        if spec.precompiled_charsmap or whole.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("character maps and spaces after words aren't supported")
        space = SPACE if spec.escape_whitespaces else " "
        self.arcs, self.squeeze = {" ": space} if space != " " else {}, spec.remove_extra_whitespaces
        self.before = space if spec.add_dummy_prefix else ""

    def __call__(self, text: str) -> str:
        """The composition of a text with the normaliser: it is deterministic, so one string."""
        if self.squeeze:
            text = " ".join(filter(None, text.split(" ")))
        for read, written in self.arcs.items():
            text = text.replace(read, written)
        return self.before + text if text else ""


def cutter(pieces: dict[str, int]) -> re.Pattern:
    """The pattern of pre-tokens: no piece crosses from one to the next, so each is encoded alone.

    A pre-token is a run of spaces with what follows up to the next space, and each newline alone. Raises ValueError for
    a model whose pieces would cross these cuts.
    """
    if any(SPACE in p.lstrip(SPACE) for p in pieces) or any("\n" in p for p in pieces):
        raise ValueError("this model's pieces cross spaces or newlines")
    return re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


def slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts in `column` have about `most` bytes together, or of one longer text."""
    if batch.num_rows:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(sizes, dtype=np.int64) - sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)
