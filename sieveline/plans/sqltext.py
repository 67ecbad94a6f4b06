"""SQL of the normal forms, for the oracle: compatibility mappings are generated from Unicode data by rule."""

from __future__ import annotations

import unicodedata

_BLOCKS = ((0xA0, 0x100), (0x132, 0x150), (0x17F, 0x180), (0xE33, 0xE34), (0xEB3, 0xEB4), (0x1C4, 0x1CD), (0x1F1, 0x1F4), (0x2000, 0x2070), (0x2070, 0x20A0), (0x2100, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0x3200, 0x3400), (0xFB00, 0xFB07), (0xFE10, 0xFE70), (0xFF00, 0xFFF0), (0x2F00, 0x2FE0), (0xF900, 0xFA70))
_ONE: dict[str, str] = {}
_MANY: dict[str, str] = {}
for _a, _z in _BLOCKS:
    for _code in range(_a, _z):
        _new = unicodedata.normalize("NFKC", chr(_code))
        if _new != chr(_code):
            (_ONE if len(_new) == 1 else _MANY)[chr(_code)] = _new

BLANKS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Macros that the other statements use; a statement that needs them begins with their definition as CTE-free text.
def nfkc(x: str) -> str:
    many = [(c, n) for c, n in _MANY.items()]
    lookup = "map([" + ",".join(_quote(c) for c, _ in many) + "],[" + ",".join(_quote(n) for _, n in many) + "])"
    letters = f"list_transform(string_split(translate({x}, {_quote(''.join(_ONE))}, {_quote(''.join(_ONE.values()))}), ''), lambda c: coalesce({lookup}[c], c))"
    return f"nfc_normalize(CASE WHEN {x} = '' THEN '' ELSE array_to_string({letters}, '') END)"


def alnum(x: str) -> str:
    return rf"replace(regexp_replace(lower({nfkc(x)}), '[^\p{{L}}\p{{N}}]', '', 'g'), 'ς', 'σ')"


def nospace(x: str) -> str:
    return f"replace(replace(lower(regexp_replace({nfkc(x)}, '{BLANKS}+', '', 'g')), 'ß', 'ss'), 'ς', 'σ')"


def collapse(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '{BLANKS}+', ' ', 'g'), '^ | $', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANKS}+|{BLANKS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"
