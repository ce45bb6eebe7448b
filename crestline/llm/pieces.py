"""Vocabulary of a SentencePiece model and the split of a text into units.

A unit is a stretch of text that no piece of the vocabulary can cross the border
of, so a text's segmentation is the concatenation of its units' and each distinct
unit is segmented once per Python worker (a memo of bounded size).  Whether
letters may be cut from what surrounds them is derived from the vocabulary:
the finer split is used only if no piece joins a letter and another character
(a leading blank marker aside).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

MARK = "▁"
@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[str, ...]  # by id; the marker is written as U+2581
    scores: tuple[float, ...]
    normal: frozenset[int]
    byte_ids: tuple[int, ...]  # id of each byte, -1 if there is none
    unknown: int

    @property
    def unit_pattern(self) -> re.Pattern:
        """The finest split found safe for this vocabulary.

        Blanks only lead pieces (checked), so a unit starts at a run of blanks.  A
        word of letters is cut off before each character of ``ends``: those that no
        piece holds right after a letter.
        """
        inner = [self.pieces[i].replace(MARK, " ").lstrip(" ") for i in self.normal]
        if any("\n" in p for p in inner):
            return re.compile(r"[\s\S]+")
        if any(" " in p for p in inner):
            return re.compile(r"[^\n]+|\n")
        after = {b for p in inner for a, b in zip(p, p[1:]) if a.isalpha()}
        ends = "".join(re.escape(c) for c in ".,;:!?)]}|\"" if c not in after)
        return re.compile((rf" *[^\W\d_]++(?=[{ends}])|" if ends else "") + r" *[^ \n]+|\n| +")


def load(path: str) -> Vocabulary:
    """Read the file with its own library; done once, on the driver."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = tuple(sp.id_to_piece(i) for i in range(n))
    byte_ids = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    normal = frozenset(i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)))
    return Vocabulary(pieces, tuple(sp.get_score(i) for i in range(n)), normal, tuple(byte_ids), sp.unk_id())


def marked(text: str) -> str:
    """The text as the model sees it: one blank in front, markers as blanks."""
    return " " + text.replace(MARK, " ") if text else ""
