"""Characters that look alike: one consistent form for a text.

The form: accented letters are single composed characters, letters and digits have ordinary width
and are not joined in ligatures, the only blank is the ordinary space (line breaks stay), nothing is
invisible, and every word keeps to one script.
"""

from __future__ import annotations

import re
import unicodedata

# Letters of other scripts that look like a Latin letter.
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "І": "I", "Ї": "Ï", "Ј": "J", "К": "K", "М": "M", "Н": "H",
    "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "Ү": "Y", "Һ": "H", "Ԍ": "G",
    "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "а": "a", "е": "e", "і": "i", "ї": "ï", "ј": "j", "о": "o", "р": "p",
    "с": "c", "у": "y", "х": "x", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ѵ": "v", "ү": "y",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "г": "r", "п": "n", "ь": "b", "Ь": "b", "Ё": "Ë",
    "ё": "ë", "ӏ": "l", "Ӏ": "I",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J", "α": "a", "ε": "e", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c",
    "ϳ": "j", "σ": "o", "β": "ß",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "Օ": "O", "Տ": "S",
}

#: Characters that are never seen: format and control characters, fillers and variation selectors.
INVISIBLE = (
    r"\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u0084\u0086-\u009f\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5"
    r"\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb"
)
#: Blanks other than the ordinary space and line breaks.
BLANKS = r"\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
#: Letters and digits of another width or of mathematical alphabets, and letters joined in one character. Latin small capitals are letters of their own.
WIDE = r"\uff01-\uff5e\uff61-\uff9f\uffe0-\uffee\U0001d400-\U0001d7ff"
LIGATURES = r"\ufb00-\ufb06\ufb13-\ufb17\u0132\u0133\u01c4-\u01cc\u01f1-\u01f3"

_INVISIBLE = re.compile(f"[{INVISIBLE}\\U000e0000-\\U000e0fff]")
_BLANK = re.compile(f"[{BLANKS}]")
_WIDE = re.compile(f"[{WIDE}]+")
_LIGATURE = re.compile(f"[{LIGATURES}]")
#: A word goes on over apostrophes, full stops and hyphens between letters.
_WORD = re.compile(r"[^\W_]+(?:['’.\-&][^\W_]+)*")
_SCRIPTS = ("LATIN", "CYRILLIC", "GREEK", "ARMENIAN")
_TO_OTHER: dict[str, dict[str, str]] = {}


def script(ch: str) -> str:
    """LATIN, CYRILLIC, GREEK, ... of a letter; '' for what belongs to every script."""
    if ch < "\x80":
        return "LATIN" if ch.isalpha() else ""
    if not ch.isalpha():
        return ""
    name = unicodedata.name(ch, "").split(" ", 1)[0]
    return name if name in _SCRIPTS else ("" if name in ("MODIFIER", "FEMININE", "MASCULINE", "MICRO") else name)


for _other, _latin in LOOKALIKES.items():
    _TO_OTHER.setdefault(script(_other), {}).setdefault(_latin, _other)


def _one_script(m: re.Match[str]) -> str:
    word = m.group()
    if word.isascii():
        return word
    scripts = {s for s in map(script, word) if s}
    if len(scripts) < 2 or "LATIN" not in scripts:
        return word
    other = [ch for ch in word if script(ch) not in ("", "LATIN")]
    if all(ch in LOOKALIKES for ch in other):
        return "".join(LOOKALIKES.get(ch, ch) for ch in word)
    rest = scripts - {"LATIN"}
    back = _TO_OTHER.get(next(iter(rest)), {}) if len(rest) == 1 else {}
    if all(ch in back for ch in word if script(ch) == "LATIN"):
        return "".join(back[ch] if script(ch) == "LATIN" else ch for ch in word)
    return word


def consistent(text: str | None) -> str | None:
    """`text` in the consistent form; null stays null, an empty text stays empty."""
    if text is None or (text.isascii() and text.isprintable()):
        return text
    text = _INVISIBLE.sub("", text)
    text = _BLANK.sub(" ", text)
    text = _WIDE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    text = _LIGATURE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), text)
    return _WORD.sub(_one_script, unicodedata.normalize("NFC", text))
