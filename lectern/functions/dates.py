"""Month expressions over raw, multilingual date strings."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and abbreviations in en, de, fr, es, pt and ar, by month.
MONTH_NAMES = {
    1: "january,jan,januar,jän,jänner,janvier,janv,enero,ene,janeiro,يناير,كانون الثاني",
    2: "february,feb,februar,février,févr,fév,fevrier,febrero,fevereiro,fev,فبراير,شباط",
    3: "march,mar,märz,mär,mrz,maerz,mars,marzo,março,marco,مارس,آذار",
    4: "april,apr,avril,avr,abril,abr,أبريل,ابريل,إبريل,نيسان",
    5: "may,mai,mayo,maio,مايو,أيار",
    6: "june,jun,juni,juin,junio,junho,يونيو,حزيران",
    7: "july,jul,juli,juillet,juil,julio,julho,يوليو,تموز",
    8: "august,aug,août,aout,agosto,ago,أغسطس,اغسطس,آب",
    9: "september,sep,sept,septembre,septiembre,setiembre,set,setembro,سبتمبر,أيلول",
    10: "october,oct,oktober,okt,octobre,octubre,outubro,out,أكتوبر,اكتوبر",
    11: "november,nov,novembre,noviembre,novembro,نوفمبر",
    12: "december,dec,dezember,dez,décembre,déc,decembre,diciembre,dic,dezembro,ديسمبر",
}
# Words for "until now".
NOW_WORDS = [
    "present", "the present", "now", "current", "currently", "to date", "today", "ongoing", "to present", "until now", "till now",
    "heute", "bis heute", "aktuell", "jetzt", "laufend", "gegenwärtig", "bis jetzt",
    "à ce jour", "aujourd'hui", "aujourd’hui", "présent", "actuel", "actuellement", "en cours", "maintenant",
    "actualidad", "la actualidad", "hasta hoy", "hoy", "presente", "actual", "actualmente", "hasta la fecha", "ahora",
    "atual", "até hoje", "hoje", "atualmente", "até agora", "até o momento", "até à data", "o momento", "até ao presente",
    "الآن", "حتى الآن", "الحالي", "حتى اليوم", "اليوم", "حاليا", "حاليًا", "حتى تاريخه", "الحاضر", "حتى الوقت الحاضر",
]

_TO = "01234567890123456789"
_FROM = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"


def ascii_digits(c: Column) -> Column:
    """Arabic-Indic and Persian digits as ASCII digits."""
    return F.translate(c, _FROM, _TO)


def month_index(year: int, month: int) -> int:
    """Months since year 0; the unit of all month arithmetic here."""
    return year * 12 + month - 1


def month_label(c: Column) -> Column:
    """A month index as ``yyyy-MM``."""
    return F.concat(F.lpad(F.floor(c / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((F.pmod(c, F.lit(12)) + 1).cast("string"), 2, "0"))


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once; Spark would otherwise copy its expression to every place that f uses it."""
    return F.transform(F.array(c), f)[0]


def parse_month(raw: Column, *, end: bool, today: datetime.date) -> Column:
    """Month index of a raw date string, or null if it can't be read.

    A bare year is January, or December where ``end``; words for "until now" are the month of ``today`` (only where ``end``).
    Null, blank and unreadable strings, and months outside 1..12 or years outside 1900..2100, give null.
    """
    names = F.create_map(*[F.lit(x) for m, ws in MONTH_NAMES.items() for w in ws.split(",") for x in (w, m)])
    patterns = (  # pattern, group of the year, group of the month, whether the month is a name
        (r"^(\d{4})\s?[-/.]\s?(\d{1,2})(?:\s?[-/.]\s?\d{1,2})?$", 1, 2, False),
        (r"^(?:\d{1,2}\s?[-/.]\s?)?(\d{1,2})\s?[-/.]\s?(\d{4})$", 2, 1, False),
        (r"^(?:\d{1,2}\.? )?(?:de )?(\p{L}+(?: \p{L}+)??)\.?,?[ /-](?:de |del )?(\d{4})$", 2, 1, True),
        (r"^(\d{4})[ /-](\p{L}+)\.?$", 1, 2, True),
    )

    def read(s: Column) -> Column:
        index = lambda y, m: F.when(m.between(1, 12) & y.between(1900, 2100), y * 12 + m - 1)
        found = F.when(s.rlike(r"^\d{4}$"), index(s.cast("int"), F.lit(12 if end else 1)))
        if end:
            found = found.when(F.rtrim(s, F.lit(".")).isin(NOW_WORDS), F.lit(month_index(today.year, today.month)))
        for p, y, m, named in patterns:
            month = F.regexp_extract(s, p, m)
            found = found.when(s.rlike(p), index(F.regexp_extract(s, p, y).cast("int"), F.try_element_at(names, month) if named else month.cast("int")))
        return found

    return bind(F.lower(F.trim(F.regexp_replace(ascii_digits(raw), r"[\s\u00a0]+", " "))), read)
