"""Reading names that people typed: legal form, line of business, given name and the name proper."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Legal forms, without dots and blanks.
LEGAL = set(
    "ab ag bv nv sa sas sarl srl spa gmbh kg ohg ug inc incorporated ltd limited llc llp lp plc corp corporation co company oy as aps sl pty "
    "aktiengesellschaft gesellschaftmbh gesellschaftmitbeschraenkterhaftung".split()
)
# Words of business names and their usual short forms; a bar parts word and short forms.
WORDS = """
pharmaceuticals|pharma pharm pharmaceutical
foods|fds food
logistics|log logist lgstcs logistic
manufacturing|mfg manuf manufg
insurance|ins insur
energy|enrg enrgy nrg
packaging|pkg pack packg
engineering|eng engrg engg engr
agriculture|agri agric agr
media|med
electronics|elec electr electron
automotive|auto autom automot
construction|const constr constrn
properties|prop props property
optics|opt optic
technologies|tech techn technol technology
furniture|furn fur
consulting|cons consult consultg
mining|min
marine|mar marit
chemicals|chem chemical chems
textiles|text textile tex
transport|transp trans
services|serv svcs svc servs service
international|int intl internat internatl
group|gp grp
national|nat natl nation
holdings|hldg hldgs hold holding
industries|ind inds indus industry
enterprises|ent entpr enterprise
associates|assoc assocs
brothers|bros
foundation|found fdn fndn
institute|inst instit
university|univ uni
hospital|hosp
college|coll
sons|son
"""
# Given names and their familiar forms.
GIVEN = """
alexander|alex sasha al sandy xander
anthony|tony ant
benjamin|ben benny benji
charles|chuck charlie chas
christopher|chris kit topher
daniel|dan danny
deborah|deb debbie debby
edward|ed eddie ted ned
eleanor|ellie nell nora ella
elizabeth|liz beth lizzie betty eliza libby
frederick|fred freddie freddy
gabriel|gabe gab
gregory|greg gregg
isabella|bella izzy isa
jacqueline|jackie jacky
james|jim jimmy jamie
jonathan|jon jonny
joseph|joe joey jo
katherine|kate kathy katie kath kitty
leonard|leo len lenny
margaret|maggie peg peggy meg marge
matthew|matt matty
michael|mike mick mickey
nathaniel|nate nat nathan
nicholas|nick nicky
patricia|pat patty trish tricia
penelope|penny pen
philip|phil pip
rebecca|becky becca
richard|rick dick rich ricky
robert|bob rob bobby robbie bert
samuel|sam sammy
stephen|steve stevie
susan|sue susie suzy
theodore|theo
thomas|tom tommy
victoria|vicky vicki tori
william|bill will billy liam
andrew|andy drew
barbara|barb babs
catherine|cathy
donald|don donnie
dorothy|dot dottie
francis|frank frankie
george|georgie
harold|harry hal
henry|hank
john|jack johnny
lawrence|larry
martin|marty
peter|pete
raymond|ray
ronald|ron ronnie
timothy|tim timmy
walter|walt wally
"""
SKIP = {"the", "of", "und", "et", "y"}
_LEET = str.maketrans("0134578", "oieastb")


def _table(text: str) -> dict[str, str]:
    out = {}
    for line in text.strip().splitlines():
        word, _, short = line.partition("|")
        for w in [word, *short.split()]:
            out.setdefault(w, word)
    return out


_BUSINESS, _GIVEN = _table(WORDS), _table(GIVEN)
_INSTITUTIONS = {"foundation", "institute", "university", "hospital", "college"}
_LONG = sorted(w for w in set(_BUSINESS.values()) if len(w) >= 5)
_LONG_GIVEN = sorted(w for w in set(_GIVEN.values()) if len(w) >= 5)


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance (neighbours swapped count one) is at most ``most``; banded."""
    if abs(len(a) - len(b)) > most:
        return False
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        if min(row) > most:
            return False
        before, last = last, row
    return last[len(b)] <= most


@lru_cache(maxsize=100_000)
def _near(word: str, kind: str) -> str | None:
    """The known word that a mistyped one stands for, if just one is close."""
    if len(word) < 5:
        return None
    most = 1 if len(word) < 8 else 2
    hits = [w for w in (_LONG if kind == "business" else _LONG_GIVEN) if within(word, w, most)]
    return hits[0] if len(hits) == 1 else None


def plain(text: str) -> str:
    """Lower case without accents; digits typed for letters inside words are read as letters."""
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss")).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[a-z0-9]*[a-z][a-z0-9]*", lambda m: m[0].translate(_LEET), text)


def fold(word: str) -> str:
    """Letters that sound alike fall together; doubled letters count once."""
    word = re.sub(r"[^a-z]", "", word)
    word = word.replace("ph", "f").replace("ck", "k").replace("x", "ks")
    word = word.translate(str.maketrans("cqywz", "kkius"))
    return re.sub(r"(.)\1+", r"\1", word)


def _single(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", word)


_SINGLE = {_single(w): full for w, full in _BUSINESS.items() if len(_single(w)) >= 3}


def business(token: str) -> str | None:
    """The full business word of a token (full, short or mistyped)."""
    return _BUSINESS.get(token) or _SINGLE.get(_single(token)) or _near(token, "business")


def given(token: str) -> str | None:
    """The full given name of a token (full, familiar or mistyped)."""
    return _GIVEN.get(token) or _near(token, "given")


def _tokens(text: str) -> list[str]:
    """Words; dots and apostrophes inside a word vanish, a hyphen inside a word too; single letters in a row are one word."""
    text = re.sub(r"(?<=[a-z0-9])[.'’](?=[a-z0-9])", "", text)
    text = re.sub(r"(?<=[a-z0-9])-(?=[a-z0-9])", "", text)
    raw = re.findall(r"[a-z0-9]+", text)
    out: list[str] = []
    i = 0
    while i < len(raw):
        j = i
        while j < len(raw) and len(raw[j]) == 1:
            j += 1
        if j - i >= 2:
            out.append("".join(raw[i:j]))
            i = j
        else:
            out.append(raw[i])
            i += 1
    return out


def _merge(tokens: list[str]) -> list[str]:
    """Joins two neighbours that are one known word cut by a blank."""
    out: list[str] = []
    for t in tokens:
        if out and (out[-1] not in _BUSINESS or t not in _BUSINESS):
            both = out[-1] + t
            if both in LEGAL or (len(both) >= 5 and (both in _BUSINESS or both in _GIVEN)) or (len(both) >= 8 and _near(both, "business")):
                out[-1] = both
                continue
        out.append(t)
    return out


def read_name(name: str | None) -> tuple[str, str, list[str]]:
    """``(context, given, parts)`` of a name: business words in order of the alphabet, the given
    name of an owner-run firm ('' if none, one letter for an initial), and the folded names proper,
    one per partner.  Legal form, articles, case, accents, word order and cut words play no role.
    """
    if not name or not name.strip():
        return "", "", []
    text = plain(name)
    text = re.sub(r"\bgesellschaft m\.? ?b\.? ?h\b\.?", " gmbh ", text)
    head, comma, tail = text.partition(",")
    words: list[str] = []
    parts: list[str] = []
    first = ""
    sides = re.split(r"\s*(?:&|\band\b|\+)\s*", text.replace(",", " ") if comma else text)
    owner = any(t == "sons" or _near(t, "business") == "sons" for s in sides[1:] for t in _tokens(s)[:1])
    for n, side in enumerate(sides):
        own: list[str] = []
        for t in _merge(_tokens(side)):
            if t in LEGAL or t in SKIP:
                continue
            b = business(t)
            if b:
                words.append(b)
            else:
                own.append(t)
        if n == 0 and len(own) > 1 and (owner or len(sides) == 1):
            # an owner-run firm: one of several words is a given name or its initial
            for t in own if owner else ([own[0], own[-1]] if comma else own[:1]):
                g = t if len(t) == 1 else (given(t) if owner else _GIVEN.get(t))
                if g:
                    first = g
                    own.remove(t)
                    break
        if own:
            parts.append(fold("".join(own)))
    return " ".join(sorted(set(words))), first, sorted(p for p in parts if p)
