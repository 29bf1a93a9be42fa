"""Reading product listings: one notation for units, keys and model names of different shops."""

from __future__ import annotations

import html
import math
import re

from matchloom.llm.name_forms import within

# Keys of a listing's text (in two languages) and the attribute they state.
KEYS = {
    "brand": "brand make manufacturer hersteller marke",
    "model": "model|model number|mpn|part number|modell|modellnummer|artikelnummer|herstellernummer|teilenummer",
    "mp": "resolution|camera resolution|megapixels|effective pixels|auflösung|aufloesung|megapixel|effektive pixel",
    "zoom": "zoom|optical zoom|zoom range|zoomfaktor|optischer zoom",
    "screen": "lcd|screen|monitor|display|display size|bildschirm|bildschirmgröße|displaygröße",
    "weight": "weight|item weight|body weight|gewicht",
    "battery": "battery|battery type|akku|akkutyp",
    "iso": "iso|max iso|sensitivity|empfindlichkeit|lichtempfindlichkeit",
    "fps": "fps|burst|continuous shooting|serienbild|serienbilder|bildrate",
    "video": "video|movie mode|videoauflösung",
    "sensor": "sensor|sensor type|sensortyp",
    "compatible": "compatible with|kompatibel mit|passend für|fits",
    "type": "type|typ",
    "other": "price|our price|preis|color|colour|farbe|condition|zustand|seller note|description|beschreibung|included|lieferumfang|availability|"
    "verfügbarkeit|shipping|versand|rating|bewertung|payment|zahlung|returns|rückgabe|hinweis|garantie|warranty|sku|ean|category|kategorie",
}
# Additions that make a sister model of the same name.
SISTERS = {"s": "s", "x": "x", "lite": "lite", "light": "lite", "pro": "pro", "professional": "pro", "plus": "plus", "max": "max", "mini": "mini", "ii": "ii", "mk2": "ii", "mkii": "ii", "markii": "ii", "mark2": "ii", "iii": "iii", "mk3": "iii", "mkiii": "iii", "markiii": "iii", "mark3": "iii", "se": "se", "zoom": ""}
ACCESSORY = re.compile(
    r"\b(?:neck strap|strap for|case for|bag for|charger for|battery for|lens cap|cap for|filter for|tripod for|cable for|screen protector|protector for|"
    r"adapter for|grip for|cover for|hood for|remote for|memory card for|tasche für|akku für|ladegerät für|gurt für|schutzfolie|kompatibel mit|compatible with|spare \w+ for|\w+ for [A-Z]\w+ \S+)",
    re.I,
)

_KEY_OF = {}
for _attr, _names in KEYS.items():
    for _n in _names.split("|") if "|" in _names else _names.split():
        _KEY_OF[_n] = _attr
_ALTS = "|".join(sorted((re.escape(k) for k in _KEY_OF), key=len, reverse=True))
_FIELD = re.compile(rf"(?<![\w-])({_ALTS})\s*[:=]\s*", re.I)
_SHOP = re.compile(r"\s+(?:[|@–—]|- )\s*[^\s|@]+\s*$")
# a sister's addition behind a model name: any word of SISTERS, digits and "mark" apart or not
_ADDITION = r"(?:[ .\-]{0,2}(s|x|lite|light|pro|professional|plus|max|mini|mark ?ii|mark ?2|mk ?ii|mk ?2|ii|iii|mark ?iii|mk ?3|se))?(?![a-z0-9])"
# a code: few letters with many digits; a name: more letters with fewer digits
_CODE = re.compile(r"(?<![a-z0-9])([a-z]{1,3})[ .\-]?(\d{4,5})" + _ADDITION)
_NAME = re.compile(r"(?<![a-z0-9])([a-z]{4,}?)[ .\-]?([a-z]?\d{1,3})" + _ADDITION)
_NUM = re.compile(r"\d+(?:[.,]\d+)?")


def _number(text: str) -> float | None:
    m = _NUM.search(text)
    return float(m[0].replace(",", ".")) if m else None


def fields(text: str | None) -> dict[str, list[str]]:
    """Attribute -> stated values of a run of ``key: value``."""
    out: dict[str, list[str]] = {}
    if not text:
        return out
    text = html.unescape(text)
    hits = list(_FIELD.finditer(text))
    for m, nxt in zip(hits, [*hits[1:], None]):
        value = text[m.end() : nxt.start() if nxt else len(text)].strip(" ,;|")
        if value:
            out.setdefault(_KEY_OF[m[1].lower()], []).append(value)
    return out


def model_names(text: str, skip: set[str]) -> list[str]:
    """Model names in one notation: letters and digits together, a sister's addition behind a plus sign."""
    text = text.lower()
    out = []

    def add(base: str, addition: str | None) -> None:
        sister = SISTERS.get(re.sub(r"[ .\-]", "", addition or ""), "")
        out.append(base + (f"+{sister}" if sister else ""))

    for m in _CODE.finditer(text):
        if m[1] not in skip:
            add(m[1] + m[2], m[3])
    rest = _CODE.sub(" ", text)
    for m in _NAME.finditer(rest):
        if m[1] not in skip and m[1] not in SISTERS:
            add(m[1] + m[2], m[3])
    return sorted(set(out))


# Words of titles and values that are not model names.
PLAIN = set(
    "camera cameras kamera digital compact kompaktkamera point shoot action sports system systemkamera mirrorless dslr spiegelreflexkamera spiegelreflex csc zoom optical fach "
    "megapixel megapixels mpix million pixels resolution frames inch zoll black white silver blue red graphite green gold schwarz weiss silber blau rot free shipping official genuine "
    "limited offer best price sale deal great gift seller star rated refurbished with warranty stock neck strap battery type compatible video from only rating item model number part "
    "for and the set body weight lens versandkostenfrei neu used condition video days ships within".split()
)


def _screen(v: str) -> list[str]:
    x = _number(v)
    if not x:
        return []
    inch = x / 2.54 if "cm" in v else x
    return [f"in:{round(inch * 10)}"] if 1 <= inch <= 9 else []


def _grams(v: str) -> float | None:
    x = _number(v.replace(" ", ""))
    if not x:
        return None
    low = v.lower()
    if "kg" in low:
        return x * 1000
    if "lb" in low or "pound" in low:
        return x * 453.592
    if "oz" in low or "ounce" in low:
        return x * 28.3495
    return x


def weight_tokens(grams: float) -> list[str]:
    """Two shifted grids of steps of 3 percent: notations of one weight share at least one."""
    s = math.log(grams) / 0.03
    return [f"g0:{math.floor(s)}", f"g1:{math.floor(s + 0.5)}"]


def _megapixels(v: str) -> float | None:
    x = _number(v)
    if not x:
        return None
    return x / 1e6 if x > 10_000 else x


def spec_tokens(f: dict[str, list[str]], title: str) -> dict[str, list[str]]:
    """Attribute -> tokens in one notation; the title fills in what the text leaves out."""
    out: dict[str, list[str]] = {}
    low = title.lower()
    mp = [x for v in f.get("mp", []) if (x := _megapixels(v))]
    if not mp and (m := re.search(r"(\d+(?:[.,]\d+)?)\s?(?:mp|mpx|megapixels?|mpix)\b", low)):
        mp = [float(m[1].replace(",", "."))]
    if mp:
        out["mp"] = [f"mp:{round(mp[0] * 10)}"]
    zoom = [v for v in f.get("zoom", [])]
    if zoom:
        x = _number(zoom[0])
        out["zoom"] = [f"zm:{x:g}" if x else "zm:none"]
    elif m := re.search(r"(\d+)(?:x|-fach)\s*(?:optical\s*)?(?:zoom)?\b", low):
        out["zoom"] = [f"zm:{int(m[1])}"]
    for v in f.get("screen", [])[:1]:
        out["screen"] = _screen(v.lower())
    for v in f.get("weight", [])[:1]:
        g = _grams(v)
        if g and g > 1:
            out["weight"] = weight_tokens(g)
    for v in f.get("battery", [])[:1]:
        if m := re.search(r"[a-z]{1,4}-?\d+[a-z]{0,3}", v.lower()):
            out["battery"] = ["bt:" + m[0].replace("-", "")]
    for v in f.get("iso", [])[:1]:
        xs = [int(x.replace(",", "").replace(".", "")) for x in re.findall(r"\d[\d.,]*", v)]
        if xs:
            out["iso"] = [f"iso:{max(xs)}"]
    for v in f.get("fps", [])[:1]:
        x = _number(v)
        if x:
            out["fps"] = [f"fps:{x:g}"]
    for v in f.get("video", [])[:1]:
        if m := re.match(r"\s*(4k|8k|\d+p)", v.lower()):
            out["video"] = ["vd:" + m[1]]
    for v in f.get("sensor", [])[:1]:
        if m := re.match(r"\s*(bsi cmos|cmos|ccd)", v.lower()):
            out["sensor"] = ["sn:" + m[1].replace(" ", "")]
    return {k: v for k, v in out.items() if v}


_SPEC_WORDS = re.compile(r"\d+(?:[.,]\d+)?\s?(?:mpx?|mpix|megapixels?|million|mio)\b|\d+(?:x|-fach)\s*(?:optical\s*|optischer\s*)?(?:zoom)?\b", re.I)


def plain_title(title: str) -> str:
    return _SHOP.sub("", html.unescape(title or ""))


def title_words(title: str) -> list[str]:
    """Words of a title without the shop and the measures, each once."""
    return list(dict.fromkeys(re.findall(r"[^\W_]+", _SPEC_WORDS.sub(" , ", plain_title(title)).lower())))


def brand_of(stated: list[str], words: list[str], known: dict[str, int]) -> str | None:
    """The brand a listing states, unless it is a slip of a more frequent one in the title; else the most frequent one there; else what it states."""
    there = max((w for w in words if w in known), key=lambda w: (known[w], w), default=None)
    own = next((b for b in stated if b in known), None)
    if own and not (there and known[there] > known[own] and within(own, there, 2)):
        return own
    return there or (stated[0] if stated else None)


def read_listing(title: str, f: dict[str, list[str]], known: dict[str, int]) -> tuple[str | None, list[str], dict[str, list[str]], bool]:
    """``(brand, models, specs, accessory)`` of a listing with the stated values ``f``; known: brands that occur in it and how many listings state them."""
    title = plain_title(title)
    accessory = bool(ACCESSORY.search(title)) or "compatible" in f
    bare = _SPEC_WORDS.sub(" , ", title)
    words = re.findall(r"[^\W_]+", bare.lower())
    brand = brand_of(stated_brand(f), words, known)
    skip = PLAIN | known.keys()
    models = set(model_names(bare, skip))
    if brand in words:
        # a name without a number stands right behind the brand
        after = re.findall(r"[^\W_]+|,", bare.lower())
        at = after.index(brand) + 1
        if at < len(after) and after[at].isalpha() and len(after[at]) >= 5 and after[at] not in skip and not any(m.startswith(after[at]) for m in models):
            models.add(after[at])
    for v in f.get("model", []):
        found = model_names(v, skip)
        models |= set(found)
        rest = re.findall(r"[a-z0-9]+", v.lower())
        if not found and len(rest) == 1 and rest[0].isalpha() and len(rest[0]) >= 5 and rest[0] not in skip:
            models.add(rest[0])
    return brand, sorted(models), spec_tokens(f, title), accessory


def stated_brand(f: dict[str, list[str]]) -> list[str]:
    """Brands that the values of a text state, in one notation."""
    return [b for v in f.get("brand", []) if (b := re.sub(r"[^a-z0-9]", "", v.lower())) and len(b) < 30]


def kind(model: str) -> str:
    """'c' for a code of few letters and many digits, 'n' for a name."""
    return "c" if re.match(r"[a-z]{1,3}\d{4,5}(?:\+|$)", model) else "n"


def models_agree(a: list[str], b: list[str], within=within) -> str:
    """How the model names of two listings relate.

    'same' (one in common), 'open' (one side names none, or a code meets a name), 'near' (a
    typing error apart, same addition), 'sister' (same base, other addition), 'far' otherwise.
    """
    if not a or not b:
        return "open"
    if set(a) & set(b):
        return "same"
    x = [(*m.partition("+")[::2], kind(m)) for m in a]
    y = [(*m.partition("+")[::2], kind(m)) for m in b]
    if any(p[0] == q[0] for p in x for q in y):
        return "sister"
    for p in x:
        for q in y:
            if p[2] == q[2] and p[1] == q[1] and (within(p[0], q[0], 2) or (p[2] == "n" and (p[0].startswith(q[0]) or q[0].startswith(p[0])))):
                return "near"
    if {p[2] for p in x} & {q[2] for q in y}:
        return "far"
    return "open" if {p[1] for p in x} & {q[1] for q in y} else "sister"
