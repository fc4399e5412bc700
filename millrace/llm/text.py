"""Text helpers shared by the operators on texts; all of them take whole texts."""

from __future__ import annotations

import re
import unicodedata

_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre|section|article)\b[^<>]*>", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_WORD = re.compile(r"[^\W_]+")
#: Characters without a visible form (soft hyphen, joiners, marks of direction, byte order mark).
_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF])


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, without case, tags, invisible characters and the dots of ё. Null gives no words.

    Inline tags (``<b>``) vanish, so they don't cut a word; tags of layout (``<br/>``, ``<p>``) part words.
    """
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    text = unicodedata.normalize("NFC", text.translate(_INVISIBLE)).lower()
    return _WORD.findall(text.replace("ё", "е"))
