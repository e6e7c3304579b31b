"""Spellings of names: tokens, transliteration, nicknames, and soft weighted similarity of token sets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from lectern.llm.chars import canonical

# What isn't part of a name.
TITLES = frozenset("mx mr mrs ms miss dr prof professor dipl ing dipling msc bsc phd mba herr frau hr fr sr sra srta dom dona mme mlle m د أ م الدكتور الدكتورة الأستاذ الأستاذة السيد السيدة المهندس المهندسة jr jun sen".split())
PARTICLES = frozenset("al el bin ibn bint ben abu umm von van de der den da do dos das del la le du di y e بن ابن بنت أبو آل".split())
# Short forms of given names; every word of a line may stand for the first.
NICKNAMES = """alexander alex sascha sasha xander sandro lex ale
elizabeth liz lizzie beth betty eliza lisa lisbeth elisabeth ella
william will bill billy liam willy guillermo
robert bob bobby rob robbie bert roberto
margaret maggie meg peggy margret greta margarita margo marge
thomas tom tommy tomas
katharina kathi käthe kaethe katja katrin kate katy catherine katherine
johannes hannes hans jo johann john joao jean
francisco paco pancho fran kiko chico curro franz
josefina pepa fina josi josephine
guadalupe lupe lupita
joaquim quim joca joaquin quino
heloisa helo lola helô
beatriz bia bea betty bibi beatrice
eduardo edu duda lalo eddie ed
edward ed eddie ted ned teddy eduard
benjamin ben benny benji
samuel sam sammy samuil
matthias matze mat matt matteo matthew hias
stefan steffen stef steve stephan stephen
susanne susi susan sue sanne suse
christina tina chris christine kristina christa
ursula ulla uschi ursel
gerhard gerd gert hardy
hildegard hilde hilda
konrad conny conrad kurt
tobias tobi toby
ingrid inge inga
zacharias zach zack zacki
charlotte lotte charlie lottie lotta charly
victoria vicky vic tori vicki viktoria
rebecca becky becca bekka
patricia pat patty trish tricia patti
philippa pippa pip
leonard len leo lenny leonhard
frederic fred freddy fritz frederick friedrich fredi
theodora dora thea theo teddy
jennifer jen jenny jenn
anthony tony ant toni antony
nicolas nico nick nicki nicholas klaus niko colas
dominique domi dom nique
clement clem
veronique vero nika ronnie vroni
yvonne yve vonni evi
odile odi dilou
gabriela gabi gaby gabriele
lorenzo enzo loren renzo lorenz
ignacio nacho iñaki inaki
marisol mari sol
wanda wandi vanda
yousef yusuf youssef joseph yousif yusef
mohammed muhammad mohamed mohammad mohamad hamada
ahmed ahmad
khaled khalid
fatima fatma fatimah fati
aisha aysha ayesha aicha
layla leila laila leyla
maryam mariam miriam meryem maria
abdullah abdallah abdulla abdalla
hussein husain hussain hosein husayn
zainab zaynab zeinab zeynep
ibrahim ebrahim brahim
noura nora nura
tariq tarek tarik tareq
huda hoda
saeed said sayed
asma asmaa
mustafa mostafa
jamal gamal djamal
sarah sara""".split("\n")  # fmt: skip
_ARABIC = dict(zip("بتثجحخدذرزسشصضطظغفقكلمنه", "b t t j h x d z r z s $ s d t z G f k k l m n h".split(), strict=True))
_FOLD = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "þ": "th", "ı": "i"})
_WORD = re.compile(r"[^\W\d_]+")
_ARABIC_WORD = re.compile("[ء-ي]")


@lru_cache(1)
def _nick() -> dict[str, frozenset[int]]:
    out: dict[str, set[int]] = {}
    for i, line in enumerate(NICKNAMES):
        for w in line.split():
            out.setdefault(fold(w), set()).add(i)
    return {w: frozenset(s) for w, s in out.items()}


def nicknames(w: str) -> frozenset[int]:
    """The lines of short forms that a folded token is on."""
    return _nick().get(w, frozenset())


def fold(w: str) -> str:
    """Small letters without accents; two-letter spellings of umlauts as one letter."""
    w = "".join(c for c in unicodedata.normalize("NFKD", w.lower().translate(_FOLD)) if not unicodedata.combining(c))
    return re.sub("(?<=[bcdfghjklmnpqrstvwxz])(o|u|a)e(?=[bcdfghjklmnpqrstvwxz])", r"\1", w) if w.isascii() else w


@lru_cache(200_000)
def skeleton(w: str) -> str:
    """Consonants of a name in Latin or Arabic script, the same for its spellings in either; vowels, half-vowels and guttural stops drop out."""
    if _ARABIC_WORD.search(w):
        w = re.sub("^ال", "", w) if len(w) > 4 else w
        return re.sub("h$", "", "".join(_ARABIC.get(c, "") for c in re.sub(r"(.)\1", r"\1", w))) if len(w) > 2 else w
    s = re.sub(r"(.)\1", r"\1", w)
    for a, b in (("kh", "x"), ("gh", "G"), ("sh", "$"), ("ch", "$"), ("th", "t"), ("dh", "z"), ("ph", "f")):
        s = s.replace(a, b)
    s = re.sub("[aeiouyw]+h$", "", s) if s.endswith("h") else s
    return re.sub("[aeiouyw]", "", s).translate(str.maketrans("qcgvp", "kkjfb"))


def parse(name: str) -> list[str]:
    """Tokens of a name in order, given names first if a comma shows it: folded, without titles and particles; one letter is an initial."""
    name = canonical(name)
    if m := re.match(r"^([^,،]+)[,،]\s*(.+)$", name):
        name = f"{m.group(2)} {m.group(1)}"
    name = re.sub(r"\b[AaEe]l(?=[A-Z])", "", name.replace("عبد ال", "عبدال"))
    name = re.sub(r"(?<=[a-zß-ÿ]{3})(?=[A-ZÀ-Þ][a-zß-ÿ])", " ", name)
    raw = [w for w in _WORD.findall(name)]
    out = [fold(w) for w in raw]
    kept = [w for w in out if w not in TITLES and w not in PARTICLES or len(out) == 1]
    kept = [re.sub("^ال", "", w) if len(w) > 4 else w for w in kept]
    return kept or out


def edits(a: str, b: str, most: int) -> int:
    """Damerau-Levenshtein distance (neighbours may be swapped), or most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
        if min(row) > most:
            return most + 1
    return last[-1]


@lru_cache(200_000)
def alike(a: str, b: str) -> float:
    """How far two tokens can be one: 1 equal, less for nicknames, spellings in the other script, typing errors and initials, 0 for nothing of these."""
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        x, y = skeleton(a) if not a.isascii() else a, skeleton(b) if not b.isascii() else b
        return 0.85 if a[0] == b[0] or x[:1] and x[:1] == y[:1] or _first_sound(a) & _first_sound(b) else 0.0
    if nicknames(a) & nicknames(b):
        return 0.95
    if a.isascii() != b.isascii():
        x, y = skeleton(a), skeleton(b)
        return 0.95 if x == y and x else 0.7 if min(len(x), len(y)) > 2 and max(len(x), len(y)) > 3 and edits(x, y, 1) <= 1 else 0.0
    most = 1 if min(len(a), len(b)) < 6 else 2
    if min(len(a), len(b)) >= 3 and (n := edits(a, b, most)) <= most:
        return max(0.0, 1 - n / max(len(a), len(b)) - 0.05)
    if a.isascii() and len(a) >= 4 and (x := skeleton(a)) and len(x) > 2 and x == skeleton(b):
        return 0.75
    return 0.0


_SOUNDS = {"ا": "aieou", "أ": "aou", "إ": "ie", "آ": "a", "ع": "aoiu", "و": "wou", "ي": "yie", "ه": "h", "ج": "jg", "ق": "qkg", "ظ": "zd", "ذ": "zd", "ث": "ts", "خ": "k", "ش": "s", "غ": "g"}


def _first_sound(w: str) -> set[str]:
    c = w[0]
    return set(_SOUNDS.get(c, _ARABIC.get(c, c)))


def similarity(a: list[str], b: list[str], weight: Callable[[str], float]) -> float:
    """Soft weighted similarity of two names: the matched weight of the shorter one's tokens, each with its best partner; rare tokens weigh more, initials little.

    Every token of the longer name has one partner at most, so that repeated tokens count once.
    """
    short, long = (a, b) if (len(a), sum(map(len, a)), a) <= (len(b), sum(map(len, b)), b) else (b, a)
    free, got, whole = list(long), 0.0, 0.0
    for t in sorted(short, key=lambda t: (-len(t), t)):
        best = max(free, key=lambda u: (alike(t, u), len(u)), default=None)
        s = alike(t, best) if best else 0.0
        w = 0.3 if len(t) == 1 else weight(t)
        if s > 0.5:
            got += w * s
            free.remove(best)
        whole += w
    return got / whole if whole else 0.0
