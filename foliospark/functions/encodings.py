"""Character codes and glyph names of simple fonts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of the codes 0x80 to 0x9F in the Windows encoding; undefined codes give a bullet.
WINDOWS = "€•‚ƒ„…†‡ˆ‰Š‹Œ•Ž••‘’“”•–—˜™š›œ•žŸ"
#: Codes from 0xA1 of the standard encoding; a blank is an undefined code.
STANDARD = "¡¢£⁄¥ƒ§¤'“«‹›ﬁﬂ –†‡· ¶•‚„”»…‰ ¿ `´ˆ˜¯˘˙¨ ˚¸ ˝˛ˇ—" + " " * 16 + "Æ ª    ŁØŒº     æ   ı  łøœß"
#: Codes from 0x20 and from 0xA1 of the symbol encoding.
SYMBOL = " !∀#∃%&∋()∗+,−./0123456789:;<=>?≅ΑΒΧΔΕΦΓΗΙϑΚΛΜΝΟΠΘΡΣΤΥςΩΞΨΖ[∴]⊥_‾αβχδεφγηιϕκλμνοπθρστυϖωξψζ{|}∼"
SYMBOL_HIGH = "ϒ′≤⁄∞ƒ♣♦♥♠↔←↑→↓°±″≥×∝∂•÷≠≡≈…⏐⎯↵ℵℑℜ℘⊗⊕∅∩∪⊃⊇⊄⊂⊆∈∉∠∇®©™∏√⋅¬∧∨⇔⇐⇑⇒⇓◊〈®©™∑⎛⎜⎝⎡⎢⎣⎧⎨⎩⎪ 〉∫⌠⎮⌡⎞⎟⎠⎤⎥⎦⎫⎬⎭"
#: Dingbats whose characters are outside their block's order.
DINGBATS = {0x25: "☎", 0x2A: "☛", 0x2B: "☞", 0x48: "★", 0x6C: "●", 0x6E: "■", 0x73: "▲", 0x74: "▼", 0x75: "◆", 0x77: "◗", 0xA8: "♣", 0xA9: "♦", 0xAA: "♥", 0xAB: "♠", 0xD5: "→", 0xD6: "↔", 0xD7: "↕"}
#: Codes of the Macintosh encoding that its newer version changed.
MAC = {0xCA: " ", 0xDB: "¤"}
#: Names of glyphs that no rule below gives.
GLYPHS = """
exclam ! quotedbl " numbersign # dollar $ percent % ampersand & quotesingle ' parenleft ( parenright ) asterisk * plus + comma , hyphen - period . slash /
zero 0 one 1 two 2 three 3 four 4 five 5 six 6 seven 7 eight 8 nine 9 colon : semicolon ; less < equal = greater > question ? at @ bracketleft [ backslash \\ bracketright ]
asciicircum ^ underscore _ grave ` braceleft { bar | braceright } asciitilde ~ exclamdown ¡ cent ¢ sterling £ currency ¤ yen ¥ brokenbar ¦ section § dieresis ¨ copyright ©
ordfeminine ª guillemotleft « logicalnot ¬ registered ® macron ¯ degree ° plusminus ± twosuperior ² threesuperior ³ acute ´ mu µ paragraph ¶ periodcentered · cedilla ¸ onesuperior ¹
ordmasculine º guillemotright » onequarter ¼ onehalf ½ threequarters ¾ questiondown ¿ AE Æ Eth Ð multiply × Oslash Ø Thorn Þ germandbls ß ae æ eth ð divide ÷ oslash ø thorn þ
dotlessi ı Lslash Ł lslash ł OE Œ oe œ florin ƒ circumflex ˆ caron ˇ breve ˘ dotaccent ˙ ring ˚ ogonek ˛ tilde ˜ hungarumlaut ˝ endash – emdash — quoteleft ‘ quoteright ’ quotesinglbase ‚
quotedblleft “ quotedblright ” quotedblbase „ dagger † daggerdbl ‡ bullet • ellipsis … perthousand ‰ guilsinglleft ‹ guilsinglright › fraction ⁄ Euro € trademark ™ minus − fi ﬁ fl ﬂ
partialdiff ∂ summation ∑ product ∏ radical √ infinity ∞ integral ∫ approxequal ≈ notequal ≠ lessequal ≤ greaterequal ≥ lozenge ◊ universal ∀ existential ∃ suchthat ∋ asteriskmath ∗ congruent ≅
therefore ∴ perpendicular ⊥ similar ∼ minute ′ second ″ club ♣ diamond ♦ heart ♥ spade ♠ arrowboth ↔ arrowleft ← arrowup ↑ arrowright → arrowdown ↓ proportional ∝ equivalence ≡
carriagereturn ↵ aleph ℵ Ifraktur ℑ Rfraktur ℜ weierstrass ℘ circlemultiply ⊗ circleplus ⊕ emptyset ∅ intersection ∩ union ∪ propersuperset ⊃ reflexsuperset ⊇ notsubset ⊄ propersubset ⊂
reflexsubset ⊆ element ∈ notelement ∉ angle ∠ gradient ∇ dotmath ⋅ logicaland ∧ logicalor ∨ arrowdblboth ⇔ arrowdblleft ⇐ arrowdblup ⇑ arrowdblright ⇒ arrowdbldown ⇓ angleleft 〈 angleright 〉
Delta ∆ theta1 ϑ sigma1 ς phi1 ϕ omega1 ϖ Upsilon1 ϒ
"""
#: Accents of composed letters' names.
ACCENTS = {"grave": "̀", "acute": "́", "circumflex": "̂", "tilde": "̃", "dieresis": "̈", "ring": "̊", "caron": "̌", "cedilla": "̧"}
CODES = "".join(map(chr, range(256)))


def glyph_names() -> dict[str, str]:
    words = GLYPHS.split()
    out = dict(zip(words[::2], words[1::2])) | {"space": " "}
    for letter in map(chr, [*range(65, 91), *range(97, 123)]):
        out[letter] = letter
        for accent, mark in ACCENTS.items():
            made = unicodedata.normalize("NFC", letter + mark)
            if len(made) == 1:
                out.setdefault(letter + accent, made)
    for point in [*range(0x391, 0x3AA), *range(0x3B1, 0x3CA)]:
        words = unicodedata.name(chr(point), "").split()
        if len(words) == 4 and words[0] == "GREEK":
            name = {"LAMDA": "LAMBDA"}.get(words[3], words[3]).lower()
            out.setdefault(name.capitalize() if words[1] == "CAPITAL" else name, chr(point))
    return out


def tables() -> dict[str, str]:
    """256 characters by encoding; a code without a character has that of the Windows encoding, which stands in for it."""
    windows = CODES[:128] + WINDOWS + CODES[160:]
    fill = lambda base, start, chars: "".join(chars[i - start] if start <= i < start + len(chars) and chars[i - start] != " " else base[i] for i in range(256))
    ascii_quotes = windows.replace("'", "’").replace("`", "‘")
    symbol = fill(fill(windows, 0x20, SYMBOL), 0xA1, SYMBOL_HIGH)
    ding = "".join(DINGBATS.get(i) or (chr(0x26E0 + i) if 0x21 <= i <= 0x7E else chr(0x2460 + i - 0xAC) if 0xAC <= i <= 0xB5 else chr(0x26C0 + i) if 0xA1 <= i <= 0xFE and i != 0xF0 else windows[i]) for i in range(256))
    mac = "".join(MAC.get(i) or (bytes([i]).decode("mac_roman") if i >= 128 else chr(i)) for i in range(256))
    return {"WinAnsiEncoding": windows, "StandardEncoding": fill(ascii_quotes, 0xA1, STANDARD), "MacRomanEncoding": mac, "Symbol": symbol, "ZapfDingbats": ding}


TABLES, NAMES = tables(), glyph_names()


def base_encoding(named: Column, base_font: Column) -> Column:
    """The name of the table that a simple font's codes begin with: the one it names, else its own symbols, else Windows."""
    font = F.lower(F.regexp_replace(F.coalesce(base_font, F.lit("")), r"^[^+]*\+", ""))
    own = F.when(font.contains("zapfdingbats") | (font == "dingbats"), "ZapfDingbats").when(font.contains("symbol"), "Symbol").otherwise("WinAnsiEncoding")
    return F.when(named.isin("WinAnsiEncoding", "StandardEncoding", "MacRomanEncoding"), named).otherwise(own)


def by_table(raw: Column, table: Column) -> Column:
    """Characters of bytes (one a character) in the table of that name."""
    out = F.translate(raw, CODES[128:160], WINDOWS)
    for name, chars in TABLES.items():
        if name != "WinAnsiEncoding":
            changed = [i for i in range(256) if chars[i] != CODES[i]]
            out = F.when(table == name, F.translate(raw, "".join(CODES[i] for i in changed), "".join(chars[i] for i in changed))).otherwise(out)
    return out


def glyph_text(name: Column) -> Column:
    """The characters of a glyph's name: a variant's suffix goes, parts joined by _ are read one by one; uniXXXX..., uXXXX to uXXXXXX; '' if unknown."""
    known = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))

    def part(n: Column) -> Column:
        units = F.regexp_extract(n, "^uni((?:[0-9A-Fa-f]{4})+)$", 1)
        point = F.regexp_extract(n, "^u([0-9A-Fa-f]{4,6})$", 1)
        wide = F.decode(F.unhex(F.lpad(point, 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(known, n), F.when(units != "", F.decode(F.unhex(units), "UTF-16BE")).when((point != "") & (F.conv(point, 16, 10).cast("long") <= 0x10FFFF), wide).otherwise(""))

    plain = F.regexp_extract(name, r"^(.[^.]*)", 1)
    return F.when(name.isNull() | (name == ".notdef"), "").otherwise(F.array_join(F.transform(F.split(plain, "_"), part), ""))
