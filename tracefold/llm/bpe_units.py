"""Byte-level BPE over units: pieces of text that the pre-tokenizer can never join.

The pre-tokenizer of a byte-level BPE file starts a new pre-token wherever white space follows another
character, so a text may be cut there and the units encoded apart: the ids are those of the whole text. One
unit is white space followed by a run of other characters. Special strings hold no white space and so stay
whole inside a unit.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Between a character that no definition calls white space and an ASCII one that every definition does.
_CUT = re.compile(r"(?<=\S)(?=[\t-\r ])")

#: Texts with one of these go to the regular expression: white space next to white space, or of another kind.
_UNEVEN = ("\0", "  ", "\n\n", " \n", "\n ", *map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def units(text: str) -> list[str]:
    """Cut a text into units; joined, they are the text again. An empty text has none."""
    if not text:
        return []
    if text[0] not in " \n" and not any(x in text for x in _UNEVEN):
        # single blanks and newlines between words and no other white space: plain string operations do
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
    return _CUT.split(text)


#: A Latin letter, and what closes a word: between them a pre-token always ends.
_LATIN, _CLOSING = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "[.,;:!?]"

#: ``_CUT``, after a lone newline, and before closing punctuation.
_FINE_CUT = re.compile(rf"{_CUT.pattern}|(?<=\S\n)(?=\S)|(?<=[{_LATIN}])(?={_CLOSING})")

# the same for RE2, which knows neither these assertions nor the other kinds of white space
_BLANK = "".join(rf"\x{{{ord(x):x}}}" for x in ("\n", " ", *_UNEVEN) if len(x) == 1 and x != "\0")
_RE2_UNEVEN = rf"^[ \n]|[ \n][ \n]|[{_BLANK.replace(r'\x{a}', '').replace(r'\x{20}', '')}]"
_RE2_CUT, _RE2_NEWLINE, _RE2_CLOSING = rf"([^{_BLANK}])([\t-\r ])", rf"(\x00\n)([^{_BLANK}\x00])", rf"([{_LATIN}])({_CLOSING})"

#: Longer texts are cut one by one, as the marks could take an Arrow array over its 2 GB.
_LONG = 64 << 20


def fine_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Many texts (null: empty), cut as ``units`` does and once more where the pre-tokenizer always does, so fewer
    different strings have to be encoded: after a newline alone, and between a Latin letter and closing punctuation.

    Returns all units in one array, where each text's begin there, and their number. Some may be empty strings."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    apart = pc.or_(pc.match_substring(texts, "\0"), pc.greater(pc.binary_length(texts), _LONG))
    uneven = pc.and_not(pc.match_substring_regex(texts, _RE2_UNEVEN), apart)
    # single blanks and newlines between words and no other white space: plain replacements do
    marked = pc.replace_substring(pc.if_else(pc.or_(apart, uneven), "", texts), " ", "\0 ")
    marked = pc.replace_substring(marked, "\n", "\0\n\0")
    if pc.any(uneven).as_py():
        cut = pc.replace_substring_regex(pc.if_else(uneven, texts, ""), _RE2_CUT, "\\1\0\\2")
        marked = pc.if_else(uneven, pc.replace_substring_regex(cut, _RE2_NEWLINE, "\\1\0\\2"), marked)
    lists = pc.split_pattern(pc.replace_substring_regex(marked, _RE2_CLOSING, "\\1\0\\2"), "\0")
    at = lists.offsets.to_numpy().astype(np.int64)
    values, first, sizes = lists.flatten(), at[:-1] - at[0], np.diff(at)
    if pc.any(apart).as_py():
        cut = [_FINE_CUT.split(t) for t in texts.filter(apart).to_pylist()]
        n = np.array([len(us) for us in cut], np.int64)
        rows = apart.to_numpy(zero_copy_only=False)
        first[rows], sizes[rows] = len(values) + np.cumsum(n) - n, n
        values = pa.concat_arrays([values, pa.array([u for us in cut for u in us], values.type)])
    return values, first, sizes


def load_tokenizer(path: str):
    """The library's tokenizer, without truncation and padding; special strings in texts are handled as the
    library does by default."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark runs the tasks side by side
    import json

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    pre = spec.get("pre_tokenizer") or {}
    if (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec.get("normalizer")) != ("ByteLevel", False, True, None):
        raise ValueError(f"{path}: only byte-level BPE without a normalizer can be cut into units")
    if any(a["lstrip"] or a["rstrip"] or re.search(r"\s", a["content"]) for a in spec.get("added_tokens", [])):
        raise ValueError(f"{path}: a special string that takes in white space can't be kept whole in a unit")
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def encode_units(tokenizer, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units and the place of each unit's first one (and the end), without begin, end or other added
    tokens; one call of the library for many units."""
    if not some:
        return np.zeros(0, "<u4"), np.zeros(1, np.int64)
    e = tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
    sizes = np.bincount(np.array(e.word_ids, np.int64), minlength=len(some))
    return np.array(e.ids, "<u4"), np.concatenate([[0], np.cumsum(sizes)])


#: Whether a unit is a blank and Latin letters, one pre-token by every version of Unicode.
is_word = re.compile(f" [{_LATIN}]+").fullmatch

_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: The characters by which byte-level vocabularies write bytes; line ends stay, as they part the words of one call.
_BYTE_CHARS = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_WORD_CHARS = _BYTE_CHARS | {10: "\n"}
WORDS_A_CALL = 100


class WordTokenizer:
    """The library's tokenizer for units that are one pre-token each (``is_word``): the same model without the
    pre-tokenizer's regular expression, offsets and search for special strings, which cost more than the merges."""
    def __init__(self, tokenizer):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        special, vocab = [a.content for a in tokenizer.get_added_tokens_decoder().values()], tokenizer.get_vocab(with_added_tokens=False)
        if any(len(_FINE_CUT.split(x)) > 1 for x in special):
            raise ValueError("a special string can't be kept whole in a unit")
        #: whether words can go this way: no special string lies in one, and a token tells whether it begins one
        self.usable = not any(is_word(" " + x) for x in special) and all(c in vocab for c in _BYTE_CHARS.values())
        self.bare = Tokenizer(tokenizer.model)
        self.bare.pre_tokenizer = WhitespaceSplit()
        self.begins = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocab.items() if token.startswith(_BYTE_CHARS[32])]] = True

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_units``."""
        calls = ["\n".join(words[i:i + WORDS_A_CALL]).encode().decode("latin-1").translate(_WORD_CHARS) for i in range(0, len(words), WORDS_A_CALL)]
        ids = np.array([x for e in self.bare.encode_batch_fast(calls, add_special_tokens=False) for x in e.ids], "<u4")
        at = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        if len(at) != len(words) + 1:
            raise ValueError("the vocabulary joins or drops the beginnings of words")
        return ids, at
