"""What the two byte-pair encoders share: signs of bytes and plain characters."""

from __future__ import annotations

import re
import unicodedata

#: Below this character, letters, digits and lower case are the same in all versions of Unicode.
PLAIN_BELOW = 0x250
LETTERS = "".join(c for c in map(chr, range(PLAIN_BELOW)) if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(c for c in map(chr, range(PLAIN_BELOW)) if unicodedata.category(c)[0] == "N")
#: A character past those, or one that Python takes for white space and the tokenizers do not.
ODD = re.compile(f"[{chr(PLAIN_BELOW)}-\U0010ffff\x1c-\x1f]")


def byte_signs() -> list[str]:
    """The printable sign for each byte in byte-level vocabularies: bytes that print
    in Latin-1 stand for themselves, the others for U+0100 and up in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """A bounded dict that makes what it lacks; it starts anew when full."""

    def __init__(self, make, most: int, chars: int = 48) -> None:
        super().__init__()
        self.make, self.most, self.chars = make, most, chars

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= self.chars:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value
