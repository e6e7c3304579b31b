"""Column functions over text: anchors, terms, quotes, instruction-like lines, headings, slugs. No UDF; every pattern is the same in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.dates import ascii_digits, bind

# Letters that belong to a word (Latin and Arabic).
WORD_CLASS = "A-Za-z0-9؀-ۿ"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
LINK = r"(?:https?://|www\.)[^ \t\n<>]+"
PHONE_INTL = r"\+[0-9][0-9 ()./-]{7,18}[0-9]"
PHONE_KEYED = r"(?i)(?:phone|mobile|tel|m|هاتف|جوال)[.: ]+([+(]?[0-9][0-9 ()./+-]{6,20}[0-9])"
# The three forms of a number with the digits that each may have, in their order. An international number that is too short by itself goes on in the next line; months before years are no local numbers.
_GAP = r"(?:\h?[()./-]{1,2}\h?|\h)?"
PHONE_FORMS = [
    (r"(?iU)(?:(?:(?<!\p{L})tel|mobile|phone|cell|fax|whats\h*app|جوال|هاتف|موبايل|تليفون)(?:[:.\h]*|:\h*\n\h*)|(?<!\p{L})m[.:\h]+)([+(]?\d[\d\h()./+-]{6,20}\d)", 8, 15),
    (rf"(?U)((?:\+|(?<!\d)00)(?:(?:{_GAP}\d){{9,15}}|(?:{_GAP}\d){{1,8}}\h?\n(?:{_GAP}\d){{3,12}})(?!\d))", 9, 15),
    (r"(?U)(?<!\d)(?!0\d[./-](?:19|20)\d\d(?!\d))(0\d[\d\h()./-]{7,12}\d)(?!\d)", 9, 11),
]
# Domains and local parts that stand for no real address.
PLACEHOLDER_DOMAIN = r"(^|\.)(example|test|invalid|localhost|example\.(com|org|net))$"
PLACEHOLDER_LOCAL = r"^(your|name|email|user|username|firstname|lastname|first\.last|someone)$"
# Text that speaks to a reading model.
INJECTION = [
    r"ignore (all |any |the )?(previous|prior|above) (instructions|prompts)", r"disregard (all |any |the )?(previous|prior|above)", r"you are now", r"system prompt", r"as an ai (language )?model",
    r"(give|assign|award) (me|this candidate) (the )?(highest|full|maximum|top) (score|rank|rating)", r"do not (mention|reveal|disclose)", r"override (the )?(rules|scoring|instructions)", r"act as (the|a) ",
    r"must be (hired|selected|ranked first)", r"<\|[a-z_]+\|>", r"\[/?inst\]", r"تجاهل (كل )?التعليمات", r"امنح(ني)? (أعلى|كامل)",
]
# Labelled fields of protected attributes, en and ar.
PROTECTED = {
    "age": r"(age|date of birth|dob|born|العمر|تاريخ الميلاد)", "gender": r"(gender|sex|الجنس)", "marital": r"(marital status|الحالة الاجتماعية)", "religion": r"(religion|الديانة)",
    "nationality": r"(nationality|citizenship|الجنسية)", "ethnicity": r"(ethnicity|race)", "disability": r"(disability|الإعاقة)",
}
# Degree words by rank, ascending.
DEGREES = [
    ("diploma", 0, r"diplom[ae]?|diploma|bts|دبلوم"),
    ("bachelor", 1, r"bachelor|bsc|ba|bacharelato|grado|licence|licenciatura|بكالوريوس"),
    ("master", 2, r"master|msc|mba|mestrado|máster|ماجستير"),
    ("phd", 3, r"ph\.?d|doctorat[eo]?|doctorado|doutoramento|promotion|dr\.|دكتوراه"),
]
# Section headings, by section, in the corpus languages.
SECTIONS = {
    "summary": "summary|profil|profile|résumé|resumen|resumo|الملخص", "experience": "experience|berufserfahrung|expérience professionnelle|experiencia laboral|experiência profissional|الخبرة العملية",
    "education": "education|ausbildung|formation|formación académica|formação académica|التعليم", "skills": "skills|kenntnisse|compétences|conocimientos|competências|المهارات",
    "languages": "languages|sprachen|langues|idiomas|línguas|اللغات", "references": "references|referenzen|références|referencias|referências|المراجع",
    "personal": "personal details|persönliche angaben|informations personnelles|datos personales|dados pessoais|البيانات الشخصية",
}
# Reason codes and what they say.
REASONS = {
    "UNREADABLE_FILE": "nothing in the file can be read", "NO_IDENTITY_ANCHOR": "no contact was found", "LOW_OCR_CONFIDENCE": "the scan is hard to read", "SPARSE_TEXT": "there is little text", "SPARSE_EXTRACTION": "few fields were found",
    "MULTIPLE_CVS_IN_FILE": "the file may hold several people", "INJECTION_SUSPECTED": "the text speaks to the reader's software",
    "LLM_UNAVAILABLE": "no model was there to read it", "DUPLICATE": "the same document came before", "CONFLICTING_VERSIONS": "another version says otherwise",
}


# The same in Arabic.
REASONS_AR = {
    "UNREADABLE_FILE": "لا يمكن قراءة شيء في الملف", "NO_IDENTITY_ANCHOR": "لم يعثر على وسيلة اتصال", "LOW_OCR_CONFIDENCE": "النسخة الممسوحة صعبة القراءة", "SPARSE_TEXT": "النص قليل", "SPARSE_EXTRACTION": "حقول قليلة وجدت",
    "MULTIPLE_CVS_IN_FILE": "قد يضم الملف عدة أشخاص", "INJECTION_SUSPECTED": "النص يخاطب برنامج القارئ", "LLM_UNAVAILABLE": "لم يتوفر نموذج للقراءة", "DUPLICATE": "وصل المستند نفسه من قبل", "CONFLICTING_VERSIONS": "نسخة أخرى تقول غير ذلك",
}


def norm(c: Column) -> Column:
    """White space collapsed, trimmed, small letters."""
    return F.lower(F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " ")))


def emails(text: Column) -> Column:
    """Distinct e-mail addresses in order of occurrence, small, without a closing dot."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({EMAIL})"), 1), lambda x: F.lower(F.rtrim(x, F.lit(".")))))


def is_placeholder(email: Column) -> Column:
    """Whether an address is at a reserved domain (or under one), or a template's."""
    return F.substring_index(email, "@", -1).rlike(PLACEHOLDER_DOMAIN) | F.substring_index(email, "@", 1).rlike(PLACEHOLDER_LOCAL)


def links(text: Column) -> Column:
    """Distinct links, without closing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({LINK})"), 1), lambda x: F.regexp_replace(x, r"[.,);:\]]+$", "")))


def phone_key(raw: Column) -> Column:
    """The last nine digits of a number."""
    return F.right(F.regexp_replace(ascii_digits(raw), "[^0-9]", ""), F.lit(9))


def phones(text: Column) -> Column:
    """Distinct numbers as (key, raw), keyed forms first, then international ones; the first form of a key stays, numbers of 8 to 15 digits only."""
    plain = ascii_digits(text)
    digits = lambda x: F.length(F.regexp_replace(x, "[^0-9]", ""))
    found = F.concat(F.regexp_extract_all(plain, F.lit(PHONE_KEYED), 1), F.regexp_extract_all(plain, F.lit(f"({PHONE_INTL})"), 1))
    usable = F.transform(F.filter(found, lambda x: digits(x).between(8, 15)), lambda x: F.struct(phone_key(x).alias("key"), x.alias("raw")))
    empty = F.array().cast("array<struct<key:string,raw:string>>")
    return F.aggregate(usable, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))))


def all_phones(text: Column) -> Column:
    """Distinct numbers as (key, raw) in all forms of PHONE_FORMS: keyed, international with + or 00, local with a leading 0; the first form of a key stays."""
    plain = ascii_digits(text)

    def form(pattern: str, least: int, most: int) -> Column:
        return F.filter(F.regexp_extract_all(plain, F.lit(pattern), 1), lambda x: F.length(F.regexp_replace(x, "[^0-9]", "")).between(least, most))

    found = F.concat(*[form(*f) for f in PHONE_FORMS])
    keyed = F.transform(found, lambda x: F.struct(phone_key(x).alias("key"), x.alias("raw")))
    empty = F.array().cast("array<struct<key:string,raw:string>>")
    return F.aggregate(keyed, empty, lambda acc, x: F.when(F.exists(acc, lambda y: y["key"] == x["key"]), acc).otherwise(F.concat(acc, F.array(x))))


def term_stem(term: Column) -> Column:
    """What a small text must contain if ``term_pattern`` finds the term in it."""
    t = norm(term)
    return F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)


def term_pattern(term: Column) -> Column:
    """A pattern that finds a term as whole words, case aside, in singular or plural of its last word."""
    t = F.regexp_replace(norm(term), r"([\\.+*?()\[\]{}|^$#-])", r"\\$1")
    stem = F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.regexp_replace(t, "s$", "")).otherwise(t)
    plural = F.when(stem.rlike("[a-z]$"), F.lit("(?:e?s)?")).otherwise(F.lit(""))
    return F.concat(F.lit(f"(?i)(?:^|[^{WORD_CLASS}])"), stem, plural, F.lit(f"(?:$|[^{WORD_CLASS}])"))


def injection_hits(text: Column) -> Column:
    """Distinct fragments that speak to a model, small, in order of the patterns."""
    low = F.lower(text)
    return F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(low, F.lit(f"({p})"), 1) for p in INJECTION])))


def redact_lines(text: Column, marker: str = "[redacted]") -> Column:
    """The text with every line that speaks to a model replaced; doing it twice changes nothing more."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.lower(x).rlike("|".join(INJECTION)), F.lit(marker)).otherwise(x)), "\n")


def arabic_ratio(text: Column) -> Column:
    """Arabic letters among all letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.coalesce(F.regexp_count(text, F.lit(r"[ء-غف-يٮ-ۓ]")) / F.nullif(letters, F.lit(0)), F.lit(0.0))


def degree_rank(text: Column) -> Column:
    """The highest degree that a text names: 0 diploma to 3 doctorate; null for none."""
    low = F.lower(text)
    return F.greatest(*[F.when(low.rlike(rf"(^|[^{WORD_CLASS}])({p})($|[^{WORD_CLASS}])"), F.lit(r)) for _, r, p in DEGREES], F.lit(None).cast("int"))


def section_of(line: Column) -> Column:
    """The section that a line is the heading of, or null."""
    low = F.lower(F.trim(F.rtrim(line, F.lit(": "))))
    return F.coalesce(*[F.when(low.rlike(f"^({words})$"), F.lit(name)) for name, words in SECTIONS.items()])


def year_spans(text: Column) -> Column:
    """(first, last) years of ranges such as 2010 - 2014 in a text."""
    plain = ascii_digits(text)
    both = lambda k: F.regexp_extract_all(plain, F.lit(r"((?:19|20)[0-9]{2}) *[-–—] *((?:19|20)[0-9]{2})"), k)
    return F.arrays_zip(F.transform(both(1), lambda x: x.cast("int")).alias("a"), F.transform(both(2), lambda x: x.cast("int")).alias("b"))


def stated_years(text: Column, head: int = 900) -> Column:
    """The greatest N of phrases like "N years" at the head of a text, 1 to 45."""
    found = F.regexp_extract_all(F.lower(ascii_digits(F.substring(text, 1, head))), F.lit(r"([0-9]{1,2})\+? *(?:years|yrs|jahre|ans|años|anos|سنوات|سنة|عاما)"), 1)
    return F.array_max(F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: n.between(1, 45)))


def slug(text: Column, width: int = 48) -> Column:
    """A name that is safe in files and logs."""
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_.:+-]", "_"), 1, width)


def session_hash(chat: Column) -> Column:
    """A session's name for logs."""
    return F.concat(F.lit("s_"), F.substring(F.sha1(chat), 1, 10))


def text_hash(text: Column) -> Column:
    """Sixteen characters that stand for a trimmed text."""
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def file_kind(name: Column) -> Column:
    """pdf, docx, image or unsupported, by the suffix."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.pdf$"), "pdf").when(low.rlike(r"\.docx$"), "docx").when(low.rlike(r"\.(png|jpe?g|tiff?|bmp|webp)$"), "image").otherwise("unsupported")


def reason_text(codes: Column, arabic: bool = False) -> Column:
    """Reason codes as phrases, in English or Arabic, distinct, joined; a code that isn't known stays."""
    known = F.create_map(*[F.lit(x) for kv in (REASONS_AR if arabic else REASONS).items() for x in kv])
    return F.array_join(F.array_distinct(F.transform(codes, lambda c: F.coalesce(F.try_element_at(known, c), c))), "; ")


def lenient_json(text: Column) -> Column:
    """JSON text without a code fence around it and without what stands before and after the outermost object."""
    return bind(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""), lambda x: F.when(x.rlike(r"(?s)^[{\[]"), x).otherwise(F.regexp_extract(x, r"(?s)(\{.*\})", 1)))
