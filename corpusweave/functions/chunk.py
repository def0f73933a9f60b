"""Tokenizer interface and the sentence-aware chunker (a sequential fold over a document's sentences)."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cache

from .text import SENTENCE

TARGET, OVERLAP, MOST = 500, 60, 800
_SENTENCE = re.compile(SENTENCE)
#: compat=False: end punctuation must be followed by white space or the end, and nothing before it is lost.
_STRICT = re.compile(r"""\S.*?(?:[.!?]+["')\]”’]*(?=\s|$)|$)""", re.S)


class PieceTokenizer:
    """Words and single marks, each with the white space before it: joining the pieces gives the text back."""

    pattern = re.compile(r"\s*(?:\w+|[^\w\s])|\s+$")

    def encode(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def decode(self, pieces: list[str]) -> str:
        return "".join(pieces)


@cache
def _ranks(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class RankTokenizer:
    """A byte-level BPE vocabulary of ranks, read from a file whose path is given, once in each process."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    @property
    def model(self):
        return _ranks(self.path, self.pattern)

    def encode(self, text: str) -> list[int]:
        return self.model.encode_ordinary(text)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids)


def default_tokenizer(vocabulary: str = "byte_bpe_50k.tiktoken") -> RankTokenizer | PieceTokenizer:
    """A public BPE vocabulary where its package and library are installed (on executors too), else words and marks."""
    try:
        import public_tokenizers as public
        import tiktoken  # noqa: F401
    except ImportError:
        return PieceTokenizer()
    return RankTokenizer(public.path(vocabulary), public.PATTERN)


@dataclass(frozen=True)
class Chunk:
    text: str
    token_count: int
    heading_path: str | None


def split_sentences(paragraph: str, compat: bool = True) -> list[str]:
    found = [s for s in (m.strip() for m in (_SENTENCE if compat else _STRICT).findall(paragraph)) if s]
    return found or [paragraph]


def chunk_document(text: str | None, heading: str | None, tokenizer=None, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST, compat: bool = True) -> list[Chunk]:
    """Greedy packing of sentences up to target tokens; each chunk begins with the last one's tail of about overlap tokens."""
    tok = tokenizer or PieceTokenizer()
    size = lambda s: len(tok.encode(s))
    units: list[tuple[str, int]] = []
    for paragraph in re.split(r"\n\s*\n", (text or "").strip()):
        if not (paragraph := paragraph.strip()):
            continue
        for sentence in split_sentences(paragraph, compat):
            n = size(sentence)
            if n <= most:
                units.append((sentence, n))
                continue
            ids = tok.encode(sentence)
            parts = (tok.decode(ids[i : i + most]).strip() for i in range(0, n, most))
            units += [(p, size(p)) for p in parts if p]
    out: list[Chunk] = []
    held: list[tuple[str, int]] = []

    def flush():
        joined = " ".join(u for u, _ in held).strip()
        if joined:
            out.append(Chunk(joined, size(joined), heading))

    for unit in units:
        if held and sum(n for _, n in held) + unit[1] > target:
            flush()
            tail: list[tuple[str, int]] = []
            while len(tail) < len(held) and sum(n for _, n in tail) < overlap:
                tail.insert(0, held[-1 - len(tail)])
            held = tail
        held.append(unit)
    flush()
    return out
