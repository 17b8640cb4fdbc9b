"""A SentencePiece vocabulary with log-probabilities and an Aho-Corasick automaton over its pieces."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

SPACE = "▁"        # how the vocabulary writes a blank


@dataclass
class Vocabulary:
    """Pieces of a .model file.

    ``scores`` are log-probabilities. A unigram file has them; a BPE file has merge ranks instead, which are
    read as Zipf's law: log-probability of rank r is -log(r + 1) less the log of the sum.
    """
    pieces: list[str]
    scores: list[float]
    normal: list[bool]                  # an ordinary piece, not a control, unknown or byte piece
    byte_ids: list[int]                 # id of each byte, or -1
    unk_id: int
    unk_score: float
    automaton: object = field(repr=False, default=None)
    byte_of: dict[int, int] = field(repr=False, default_factory=dict)       # byte of each byte piece
    piece_bytes: object = field(repr=False, default=None)                   # of every id, as an Arrow array
    #: No piece holds a blank after another character, so texts may be cut before blanks.
    cuts_at_blanks: bool = True
    #: No piece holds a newline, so texts may be cut around newlines.
    cuts_at_newlines: bool = True


def load_vocabulary(path: str, zipf: bool | None = None) -> Vocabulary:
    """Read a .model file with the sentencepiece library. ``zipf`` overrides the reading of the scores."""
    import ahocorasick
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    normal = [not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) for i in range(n)]
    raw = [sp.get_score(i) for i in range(n)]
    own = [raw[i] for i in range(n) if normal[i]]
    if zipf is None:                    # ranks are whole numbers, log-probabilities are not
        zipf = all(float(s).is_integer() for s in own)
    if zipf:
        top = max(own)
        total = math.log(sum(1 / (top - s + 1) for s in own))
        scores = [-math.log(top - raw[i] + 1) - total if normal[i] else 0.0 for i in range(n)]
    else:
        scores = [float(s) for s in raw]
    byte_ids = [-1] * 256
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
    v = Vocabulary(pieces, scores, normal, byte_ids, sp.unk_id(), min(s for s, k in zip(scores, normal, strict=True) if k) - 10.0)
    a = ahocorasick.Automaton()
    for i in range(n):
        if normal[i]:
            a.add_word(pieces[i], (len(pieces[i]), scores[i], i))
    a.make_automaton()
    v.automaton = a
    v.byte_of = {i: b for b, i in enumerate(byte_ids) if i >= 0}
    v.cuts_at_blanks = not any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, normal, strict=True) if k)
    v.cuts_at_newlines = not any("\n" in p for p, k in zip(pieces, normal, strict=True) if k)
    return v


_BLANK_CUT = re.compile(f"(?<=[^{SPACE}\\n])(?={SPACE})|(?=\\n)|(?<=\\n)")


def cut(v: Vocabulary, text: str) -> list[str]:
    """The text with a blank in front and blanks written as the vocabulary has them, cut where no piece crosses.

    Joined, the parts are that string. Empty parts are possible.
    """
    s = SPACE + text.replace(" ", SPACE)
    if not (v.cuts_at_blanks and v.cuts_at_newlines):
        return [s]
    if "\0" not in s and SPACE + SPACE not in s:
        return s.replace(SPACE, "\0" + SPACE).replace("\n", "\0\n\0").split("\0")
    return _BLANK_CUT.split(s)


def best_path(v: Vocabulary, part: str) -> list[int]:
    """Ids of the segmentation with the highest score, by one pass of Viterbi over the automaton's matches.

    At each end position the automaton lists, along its output links, every piece that ends there, longest
    first; each relaxes the best score of that position, and of equal scores the longest piece stays. A
    character that no piece matches alone may also be unknown, for ``unk_score``; it is written as its bytes
    if the vocabulary has byte pieces, else as the unknown id.
    """
    n = len(part)
    best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
    at, single = 0, False               # single: a piece of one character ends at ``at``

    def unknown(i: int) -> None:
        if best[i] + v.unk_score > best[i + 1]:
            best[i + 1], back[i + 1] = best[i] + v.unk_score, (i, -1)

    for end, (size, score, piece) in v.automaton.iter(part):
        while at < end:                 # positions that are over
            if not single:
                unknown(at)
            at, single = at + 1, False
        start = end + 1 - size
        if (total := best[start] + score) > best[end + 1]:
            best[end + 1], back[end + 1] = total, (start, piece)
        single = single or size == 1
    while at < n:
        if not single:
            unknown(at)
        at, single = at + 1, False
    ids: list[int] = []
    i = n
    while i > 0:
        start, piece = back[i]
        if piece >= 0:
            ids.append(piece)
        else:
            raw = part[start:i].encode("utf-8", "surrogatepass")
            spelled = [v.byte_ids[b] for b in raw]
            ids.extend(reversed(spelled) if -1 not in spelled else [v.unk_id])
        i = start
    ids.reverse()
    return ids


def join_pieces(v: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces joined, byte pieces read as UTF-8, blanks restored, the blank in front removed."""
    out, raw = [], bytearray()
    for i in ids:
        if (b := v.byte_of.get(i)) is not None:
            raw.append(b)
            continue
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()
        out.append(v.pieces[i] if v.normal[i] else "")
    if raw:
        out.append(raw.decode("utf-8", "replace"))
    text = "".join(out).replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text
