"""Token ids from the public vocabulary files, whose path is a parameter."""

from __future__ import annotations

import base64
import re
import unicodedata
from array import array
from collections.abc import Iterable

#: Words whose ids a worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 600_000
#: Longer words are encoded for their block and not kept.
CACHE_LENGTH = 64
#: White space on which the library and str.split disagree, characters newer than the
#: library's tables or rarely met, and special tokens: such texts are encoded whole.
ODD = re.compile("[\x1c-\x1f\x85՘֋֌࢏౜೜Ᲊ₏₝-₟⃀-꯿ﬀ-\U0010ffff]|<\\|")
ODD_ASCII = re.compile("[\x1c-\x1f]")


class WordPieces:
    """Ids of a lower-casing BPE file with word ends, a white-space word at a time.

    Its pre-tokenizer never crosses white space, so a word has the same ids
    wherever it stands: the library's own BPE model encodes new words, and
    known ones come from a bounded cache.  Texts with an odd character are
    encoded whole by the library.
    """

    #: The vocabulary file's pre-tokenizer pattern (fixed value).
    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.split = regex.compile(self.PIECES).findall
        byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # Characters that stand for bytes beyond ASCII, as the byte-level step writes them.
        self.bytes: dict[int, str] = {}
        for cp in range(0x80, 0x800):
            raw, shown = chr(cp).encode(), byte_level.pre_tokenize_str(chr(cp))[0][0]
            self.bytes.update(zip(raw, shown, strict=True))
        for cp in (0x800, 0x1000, 0x2000, 0x3000, 0x4000, 0x5000, 0x6000, 0x7000, 0x8000, 0x9000, 0xA000, 0xB000, 0xC000, 0xD000, 0xE000, 0xF000):
            self.bytes.update(zip(chr(cp).encode(), byte_level.pre_tokenize_str(chr(cp))[0][0], strict=True))
        for cp in range(32):
            self.bytes[cp] = byte_level.pre_tokenize_str(chr(cp))[0][0]
        self.bytes[127] = byte_level.pre_tokenize_str("\x7f")[0][0]
        self.known: dict[str, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.bytes)
        return [t.id for t in self.model.tokenize(piece)]

    def word(self, word: str) -> bytes:
        if word.isalpha():
            ids = self.piece(word)
        elif word[-1] in ",.!?;:" and word[:-1].isalpha():
            stem = self.known.get(word[:-1])
            return (stem or self.word(word[:-1])) + self.word_of_piece(word[-1])
        else:
            ids = [i for p in self.split(word) for i in self.piece(p)]
        return array("I", ids).tobytes()

    def word_of_piece(self, piece: str) -> bytes:
        return array("I", self.piece(piece)).tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        known, out = self.known, []
        for t in texts:
            if ("<|" in t or ODD_ASCII.search(t)) if (plain := t.isascii()) else ODD.search(t):
                out.append(array("I", self.library.encode(t, add_special_tokens=False).ids).tobytes())
                continue
            t = t if plain else unicodedata.normalize("NFC", t).replace("\u03a3", "\u03c3")
            words = t.lower().split()
            try:
                out.append(b"".join([known[w] for w in words]))
                continue
            except KeyError:
                pass
            if len(known) > CACHE_WORDS:
                known.clear()
            here = {}
            for w in set(words):
                if w not in known:
                    (known if len(w) <= CACHE_LENGTH else here)[w] = self.word(w)
            out.append(b"".join([known[w] if w in known else here[w] for w in words]))
        return out


#: Where pieces could reach over a space: white space on both of its sides, or before it at the end; and special tokens.
WIDE_SPACE = re.compile(r"[\s\u180e] (?:[\s\u180e]|\Z)|<\|")

#: Marks that are a piece of their own after a letter, and the first character that is not taken for a Latin letter.
MARKS, BEYOND_LATIN = tuple(",.!?;:"), "\u0250"
#: The characters that stand for bytes in a byte-level file: printable ones for themselves, the rest from U+0100 on.
_hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SHOWN = {b: 256 + n for n, b in enumerate(_hidden)}


class BytePieces:
    """Ids of a byte-level BPE file, a space-parted chunk at a time.

    The file's pre-tokenizer gives a space to what follows it, so a chunk has
    the same ids wherever it stands, and so have the lines of a chunk: the
    library encodes new ones, and known ones come from a bounded cache.  Texts
    in which a piece could reach over a space are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("ids of 16 bits are wanted")
        self.plain: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str, before: str) -> bytes:
        """Letters are one piece, which goes to the library's BPE model at once."""
        return array("H", [t.id for t in self.model.tokenize((before + word).encode().decode("latin-1").translate(SHOWN))]).tobytes()

    def chunk(self, chunk: str, before: str) -> bytes:
        if "\n" in chunk:
            lines = chunk.split("\n")
            if not all(x and x == x.strip() for x in lines):
                return self.whole(before + chunk)
            first = self.known(lines[0], before)
            return first + b"".join(self.known("\n", "") + self.known(x, "") for x in lines[1:])
        if chunk[-1:] in MARKS and chunk[:-1].isalpha() and max(chunk) < BEYOND_LATIN:
            return self.known(chunk[:-1], before) + self.known(chunk[-1], "")
        if chunk.isalpha() and max(chunk) < BEYOND_LATIN:
            return self.word(chunk, before)
        return self.whole(before + chunk)

    def known(self, chunk: str, before: str) -> bytes:
        cache = self.spaced if before else self.plain
        found = cache.get(chunk)
        if found is None:
            found = self.chunk(chunk, before)
            if len(chunk) <= CACHE_LENGTH:
                cache[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        """Little-endian 16-bit ids."""
        if WIDE_SPACE.search(text):
            return self.whole(text)
        for cache in (self.plain, self.spaced):
            if len(cache) > CACHE_WORDS:
                cache.clear()
                self.plain[""] = b""
        first, *rest = text.split(" ")
        start, spaced = self.known(first, ""), self.spaced
        try:
            return start + b"".join([spaced[w] for w in rest])
        except KeyError:
            return start + b"".join([spaced[w] if w in spaced else self.known(w, " ") for w in rest])


class RankFile:
    """Byte-level BPE from a rank file."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def length(self, text: str) -> int:
        return len(self.library.encode_ordinary(text))


_loaded: dict[tuple, object] = {}


def loaded(kind: type, *args: str):
    """One encoder of a kind and file for each Python worker."""
    if (kind, *args) not in _loaded:
        _loaded[(kind, *args)] = kind(*args)
    return _loaded[(kind, *args)]
