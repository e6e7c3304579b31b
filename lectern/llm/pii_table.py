"""The labelled table that the personal-information model is trained on: lines with marked items, filled at random.

Each line is text with slots; a slot's words carry the label of its kind, everything else is outside. Lines without items come from the data itself: see ``pii.plain_lines``.
"""

from __future__ import annotations

import random
import re

from lectern.llm.trie import CONFUSIONS

KINDS = ["email", "phone", "identity_number", "street_address", "person_name"]
LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Tokens: a line break, a run of letters, digits, @ and joining signs, any other sign.
TOKEN = re.compile(r"\n|[\w@]+(?:[.+'’_‐-]+[\w@]+)*|[^\w\s]")

# Common given names, and parts that made-up family names are put together from.
GIVEN = (
    "Anna Peter Maria James Laura Daniel Sophie Martin Julia Paul Emma Lucas Clara Victor Nina Oscar Helen Simon Alice Georg Marta Hugo Irene Felix Carmen Diego Ines Bruno Lucia Rafael Sofia Andre Camille Louis Chloe Antoine Heinrich Greta Otto Ursel Ralph Megan Colin Bob Liz Tom Kate Will Meg Jim Sue Omar Karim Salma Rania Nadia Samir "
    "Jennifer Elizabeth Robert Thomas Alexander Samuel Benjamin William Edward Charlotte Margaret Victoria Rebecca Patricia Christina Hannah Anthony Leonard Philippa Theodora Frederick "
    "Johannes Matthias Tobias Katharina Hildegard Konrad Gerhard Susanne Ursula Ingrid Stefan Wanda Zacharias Philipp Franziska Bernhard Hannes Clement Odile Veronique Yvonne Dominique Frederic Nicolas Benoit Mathilde Pierre "
    "Guadalupe Francisco Eduardo Gabriela Ignacio Josefina Marisol Beatriz Lorenzo Joaquim Heloisa Teresa Alvaro Pilar Rodrigo Fernanda Ahmed Mohammed Fatima Aisha Khaled Layla Yousef Maryam Abdullah Sarah Hussein Zainab Ibrahim Noura Tariq Huda Saeed Asma Mustafa Jamal"
).split()
ARABIC_GIVEN = "محمد أحمد فاطمة عائشة خالد ليلى يوسف مريم عبدالله سارة حسن زينب إبراهيم نورة طارق هدى سعيد أسماء مصطفى جمال علي عمر هند رنا سامي كريم حسين شهد وليد منى".split()
FRONT = "Hart Berg Lind Stein Wald Mor Kel Bran Tor Val Fen Gar Dun Strö Pen Quin Ras Sul Or Has Nag Mül Bröt Zol Vel Ash Cald Jor Köh Lé Nañ Ara Vir Bou Kes Wex Ulv Hjor Dra Gries Dorn Pé Ñan Sør El Tres".split()
BACK = "mann er son ley ton wick stad quist elho ino ez berg moor acre ander erly ette ough ivar hausen aux ik otto enza aldo ellan owe orez ein ini as ard".split()
ARABIC_STEM = "بحر رمل نخل جبل صخر وادي مرج كرم شمس نجم فجر غيم حجر سدر قمر ندى رعد برق طيب حرب سلم دوس خزر عتب زهر هلل ورود زهور نخيل بساتين مدارس ميناء سوق محطة حديقة".split()
_TITLES = ["Dr. ", "Prof. ", "Mx ", "Dipl.-Ing. ", "Mr. ", "Ms ", "Frau ", "Herr ", "Dr ", "Sra. ", "Mme "]

# How numbers of persons are named.
ID_WORDS = [
    "SSN", "SSN:", "National ID", "National ID:", "Passport no.", "passport number", "Passport no.:", "holder of identity number", "identity card", "ID card", "residence permit", "tax ID", "Tax no.", "National insurance no.", "ID card no.",
    "Steuer-ID:", "Steuer-ID", "Ausweisnummer", "Ausweisnummer:", "Reisepass Nr.", "Sozialversicherungsnr.", "Personalausweis", "Steuernummer",
    "N° de sécurité sociale", "N° de sécurité sociale:", "Passeport n°", "carte d'identité", "carte d'identité n°", "titre de séjour", "numéro fiscal",
    "DNI", "DNI:", "NIE", "NIE:", "NIF", "NIF:", "Pasaporte n.º", "Número de seguridad social", "Passaporte n.º", "Cartão de cidadão", "Cartão de cidadão:", "CPF", "NISS",
    "رقم الهوية", "رقم الهوية:", "جواز سفر رقم", "رقم الإقامة", "رقم الإقامة:", "الرقم الضريبي", "رقم الضمان الاجتماعي",
]
# Forms of identity numbers; A a letter, 9 a digit.
ID_FORMS = ["A99AA9999", "A9999999", "99999999-A", "999-99-9999", "AA 999 9999", "9999999999", "9999999999", "9999999999", "99 999 999 999", "AA999999", "9 99 99 99 999 999 99", "999999999", "A 999 999", "999 999 999", "99/999/99999", "A99999999", "9999-9999-9999"]
# Forms of telephone numbers.
PHONE_FORMS = ["+99 999 999 9999", "+9 999 999 9999", "+9 999 9999999", "+99999999999", "+999999999999", "009999999999999", "0099999999999", "(999) 999-9999", "999-999-9999", "9999/999 99 99", "99.99.99.99.99", "99.99.99.99.99", "009999999999999", "+99 (0)999-9999999", "+9 (0)999-9999999", "999-999-9999 ext. 99", "+999 999 999 9999", "999 9999999", "0999 999 9999", "+999 999 9999999", "(0999) 999999"]
_PHONE_WORDS = ["Tel. ", "M: ", "Mobile: ", "", "", "", "", "", "", "Tel.: ", "Phone: ", "Telefon: ", "Tél. ", "Móvil: ", "هاتف: ", "Telemóvel: "]
_MAIL_WORDS = ["E-mail: ", "Mail ", "@: ", "", "", "Email: ", "Correo: ", "البريد: "]
_HOSTS = "mail.example box.example inbox.test post.invalid letters.example webmail.test mail.north.example company.example".split()
# Words of streets.
STREETS = {
    "en": ["{n} {S} {T}", "{n}-{n} {S} {T}, Apt {a}", "Flat {m}, {n} {S} {T}", "{n} {S}'s {T}", "P.O. Box {n}", "Apt {a}, {n} {S} {T}", "{n} Old {S} {T}", "{n} Old {S} St.", "{n} Old {S} St.", "{n} {S} St.", "{n} New {S} {T}", "{n} {S} {S} {T}", "Unit {m}, {n} {S} {T}"],
    "de": ["{S}str. {n}", "{S}straße {n}", "{S}weg {n}", "{S}gasse {n} b", "{S}allee {n}", "Am {S} {n}", "Alten {S} {n}", "Postfach {n}", "{S}platz {n}", "{S}str. {n}a", "Am Alten {S} {n}", "Zum {S} {n}"],
    "fr": ["{n}, rue des {S}", "{n} bis rue de la {S}", "{n} rue {S}", "{n}, impasse du {S}", "{n} bis bd. de l'{S}", "{n}, bd. de l'{S}", "{n} bis bd. de l'{S}", "{n}, bd. {S}", "{n} bis bd. du {S}", "{n} bis bd. de l'{S}", "{n} bis impasse {S}", "{n} boulevard de l'{S}", "{n} avenue {S}", "{n}, avenue des {S}", "{n} quai {S}", "BP {n}", "{n}, place du {S}", "{n} bis avenue des {S}"],
    "es": ["C/ {S} {S} n.º {n}", "C/ {S} {S}, {n}, {m}º B", "Calle del {S} n.º {n}", "C/ {S}, {n}, {m}º B", "Avda. de la {S} n.º {n}", "Plaza del {S}, {n}", "Paseo {S} {n}", "Apdo. de Correos {n}", "Calle del {S}, {n}, {m}º A"],
    "pt": ["Rua das {S} {n}", "Av. do {S} {n}", "Travessa do {S}, {n}, {m}.º Esq.", "Largo da {S} {n}", "Rua {S}, {n}", "Caixa Postal {n}", "Apartado {n}", "Av. do {S}, {n}, {m}.º Dir."],
    "ar": ["شارع {R} {n}", "شارع {R}، مبنى {n}، ص.ب {n}", "طريق {R}، مبنى {n}", "طريق {R} {n}", "شارع {R} {n}", "زقاق {R} {n}", "حي {R}، شارع {R} {n}", "ص.ب {n}", "ميدان {R}، عمارة {n}", "طريق {R} {n}"],
}
_STREET_STEMS = "Quarrel Mill Heron Bell Old Harbour Linden Rosen Garten Ufer Saules Four Écluse Moulin Prés Molino Olmo Horno Ribera Puente Cais Poço Fonte Amoreiras Ponte Tannery Cooper Birken Tannen Fähr Gerber Speicher Markt Brunnen Chênes Olivos Castelo".split()
_STREET_TYPES = "Road Street St. Lane Ave Avenue Court Row Close Drive Way Race Place Square Hill Terrace".split()
_CITIES = "Harbury Altdorf Montval Ribera Portela Kestrel Newford Sandhaven Brückstadt Valmont".split()
_REGIONS = ["{c} AB{d} {d}QT", "{z} {c}", "{c} {z}", "D-{z} {c}", "{c}", "{c}", "- {c}", "- {c}", "{zz} {c}"]
_ARABIC_REGION = ["حي {R}، مدينة {R}", "مدينة {R}", "حي {R}"]

# Sentences and lines with items, in the words of the writer of this table; {name}, {email}, {phone}, {id}, {addr} are slots.
LINES = [
    "My line manager was {name}, who signed every roster.", "{name} hired me straight from school.", "Took over the ledger when {name} retired.", "Ask {name} about the warehouse move.", "For details call {name}.", "Paired with {name} on the rollout.", "Thanks to {name} the audit went smoothly.", "Supervisor: {name}", "Contact person: {name}", "Mentored by {name}, then by {name}.", "Signed, {name}", "Team of {name} and {name}.",
    "Mein Vorgesetzter war {name}.", "{name} stellte mich nach der Lehre ein.", "Vertretung für {name} im Sommer.", "Auskunft gibt {name}.", "Gemeinsam mit {name} entstand der Plan.", "Ansprechpartner: {name}", "Gezeichnet {name}", "Dank {name} gelang die Umstellung.", "Eingearbeitet durch {name}, danach durch {name}.", "Unterstützte {name} bei der Abrechnung.",
    "Mon chef direct était {name}.", "{name} m'a recruté après le stage.", "Remplacement de {name} en été.", "Renseignements auprès de {name}.", "Projet mené avec {name} à distance.", "Personne à contacter : {name}", "Formé par {name} puis par {name}.", "Grâce à {name}, la migration a réussi.", "Signé {name}",
    "Mi jefe directo era {name}.", "{name} me contrató tras las prácticas.", "Sustitución de {name} en verano.", "Más datos con {name}.", "Trabajé junto a {name} en la campaña.", "Persona de contacto: {name}", "Formado por {name} y luego por {name}.", "Gracias a {name} salió bien la auditoría.", "Firmado: {name}",
    "O meu chefe direto era {name}.", "{name} contratou-me depois do estágio.", "Substituição de {name} no verão.", "Mais dados com {name}.", "Trabalhei ao lado de {name} na campanha.", "Pessoa de contacto: {name}", "Formado por {name} e depois por {name}.", "Graças a {name} a auditoria correu bem.", "Assinado: {name}",
    "مديري المباشر كان {name}.", "عينني {name} بعد التدريب.", "ناب عن {name} في الصيف.", "للمعلومات اسأل {name}.", "عمل إلى جانب {name} في الحملة.", "الشخص المسؤول: {name}", "بفضل {name} نجح التدقيق.", "التوقيع {name}", "تدرب لدى {name} ثم لدى {name}.",
    "Send offers to {email}, please.", "My inbox is {email} on weekdays.", "Angebote an {email} senden.", "Mein Postfach ist {email}.", "Envoyez vos offres à {email}.", "Ma boîte est {email}.", "Mande ofertas a {email}.", "Mi buzón es {email}.", "Envie ofertas para {email}.", "A minha caixa é {email}.", "أرسل العروض إلى {email} من فضلك.", "صندوقي هو {email}.",
    "Ring {phone} before noon.", "Voicemail is on {phone} at weekends.", "Vormittags unter {phone} anrufen.", "Anrufbeantworter: {phone}", "Appeler le {phone} avant midi.", "Répondeur au {phone} le week-end.", "Llame al {phone} antes de mediodía.", "Contestador en el {phone}.", "Ligue para {phone} antes do meio-dia.", "Atendedor no {phone}.", "اتصل على {phone} قبل الظهر.", "المجيب الآلي {phone}.",
    "My flat is at {addr}.", "Home: {addr}", "Since spring I live at {addr}.", "Parcels reach me at {addr}, ground floor.", "Meine Wohnung liegt {addr}.", "Wohnhaft: {addr}", "Pakete bitte an {addr} liefern.", "J'habite {addr}.", "Domicile : {addr}", "Colis à livrer au {addr}.", "Vivo en {addr}.", "Domicilio: {addr}", "Paquetes a {addr}, planta baja.",
    "Moro na {addr}.", "Morada: {addr}", "Encomendas para {addr}, rés do chão.", "أسكن في {addr}.", "السكن: {addr}", "الطرود إلى {addr} من فضلك.", "Write or call: {email}, {phone}", "Reach {name} on {phone} or {email}.", "{name} ({phone}) keeps the keys.", "{name}, {addr}",
]
# Sentences that name a street, a person or a number without giving an item.
NO_ITEMS = [
    "The {S} {T} scheme has {n} stops.", "Drew the plans of the {S} {T} depot, {n} sheets.", "Bauvorhaben {S}weg: {n} Pläne gezeichnet.", "Bauvorhaben {S}straße, {n} Pläne.", "Chantier Rue {S} : {n} plans.", "Chantier Avenue {S}, {n} plans.", "Obra Calle {S}: {n} planos.", "Obra Plaza {S}, {n} planos.",
    "Obra Rua {S}: {n} plantas.", "Obra Largo {S}, {n} plantas.", "مشروع طريق {R} وفيه {n} محطة.", "مشروع شارع {R}، رسم {n} مخططا.", "Filed {d} {d}00 000 entries.", "{d} {d}00 000 Zeilen je Woche.", "Jusqu'à {d} {d}00 000 lignes.", "Unas {d} {d}00 000 filas.", "Order PO-20{m}-{n} closed in {m} days.", "Project {S} {T} with {n} people.", "Projekt {S}gasse, {n} Leute.", "Projet Rue {S}, {n} personnes.", "Proyecto Calle {S} con {n} personas.", "Projeto Rua {S} com {n} pessoas.",
]
# Forms of numbers that are no items: amounts, tickets, orders, versions, standards, certificates.
NUMBERS = ["{d} {d}00 000", "{m}{d} 000", "{d}.{d}00.000", "{d},{d}00,000", "TKT-20{m}-{n}", "PO {n}-{n}", "v{d}.{m}.{n}", "{d}.{d}.{m}.{n}", "ISO {n}:20{m}", "n° {n}{m}", "No. {n}-{m}"]
HEADERS = ["{job} - {name}", "{job} - {name}", "{job}    {name}", "{job} - {name}   {p}", "Lebenslauf {name}", "Résumé: {name}", "Résumé - {name}", "Profile - {name}", "Dossier - {name}   {p}", "Bewerbung - {name}", "Dossier    {name}", "{name} / Résumé", "{name}  |  CV", "{name}, {job}", "{name}  |  CV   {p}", "CV {name}", "CV of {name}   {p}", "File of {name}", "{name} - {p}", "Application of {name}"]
REFEREES = ["{name}, {org}", "{name}, {org}, {email}", "{name}, {org}, {phone}", "{name}, {org} - {phone}", "{name}, {org}, Tel. {phone}", "{name}, {org}, {email}", "{name} ({org})", "{org}: {name}"]
SEPARATORS = [" | ", " · ", ", ", "  ", "  ", "  ", "  ", "\n", "\n", "\n"]
HEADINGS = "References|Referenzen|Références|Referencias|Referências|المراجع".split("|")
DETAILS = "Personal details|Persönliche Angaben|Informations personnelles|Datos personales|Dados pessoais|البيانات الشخصية".split("|")


class Writer:
    """Random pages with marked items. jobs, organisations, plain: lines of the data without items, that stand around them."""

    def __init__(self, seed: int, jobs: list[str], organisations: list[str], plain: list[str], lines: list[str] | None = None) -> None:
        self.r, self.lines = random.Random(seed), lines or LINES
        self.words = [w for w in sorted({w for x in plain[:3000] for w in x.split() if w.isalpha() and w[0].islower()})] or ["and"]
        self.cities = _CITIES + [w for w in sorted({w.strip(",.") for x in plain[:3000] for w in x.split()}) if len(w) > 4 and w.istitle() and w.isalpha()][:400]
        self.jobs, self.organisations, self.plain = jobs or ["Engineer"], organisations or ["Company Ltd"], plain or ["Skills"]

    def form(self, form: str) -> str:
        out = "".join(self.r.choice("0123456789") if c == "9" else self.r.choice("ABCDEFGHJKLMNPQRSTVWXYZ") if c == "A" else c for c in form)
        return out.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")) if self.r.random() < 0.05 else out

    def family(self) -> str:
        s = self.r.choice(FRONT) + (self.r.choice(FRONT).lower() if self.r.random() < 0.2 else "") + self.r.choice(BACK)
        if self.r.random() < 0.12:
            return f"{self.r.choice(['Al', 'El', 'al', 'Ben'])}-{s}"
        if self.r.random() < 0.05:
            return f"{self.r.choice(['Al', 'El', 'bin Omar Al', 'bin Karim'])} {s}"
        return f"{s}-{self.r.choice(FRONT)}{self.r.choice(BACK)}" if self.r.random() < 0.12 else s

    def name(self, arabic: bool | None = None) -> str:
        r = self.r
        if arabic if arabic is not None else r.random() < 0.18:
            fam = "ال" + r.choice(ARABIC_STEM) + r.choice(["اني", "اوي", "ي", "ان", ""])
            g = [r.choice(ARABIC_GIVEN) for _ in range(r.choice([1, 1, 2]))]
            return r.choice([" ".join([*g, fam])] * 4 + [f"{fam}، {' '.join(g)}", f"{g[0]} {fam[2]}.", f"{g[0]} بن {g[-1]} {fam}", f"{g[0]} {g[-1][0]}. {fam}"])
        g, s = [r.choice(GIVEN) for _ in range(r.choice([1, 1, 1, 2]))], self.family()
        if r.random() < 0.3:  # any made-up given name
            g = [r.choice(FRONT) + r.choice("a o e ia us ine ard ette".split()) for _ in g]
        full = r.choice([f"{' '.join(g)} {s}"] * 8 + [f"{g[0][0]}. {s}"] * 4 + [f"{s}, {' '.join(g)}", f"{s}, {g[0]} {r.choice('ABEJMS')}.", f"{g[0]} {r.choice('ABEJMS')}. {s}", f"{s.upper()} {g[0]}", f"{s} {g[0]}", f"{g[0]} {s}".lower(), f"{g[0]} {s}".upper(), f"{g[0]} {s[0]}."])
        if r.random() < 0.07:
            i = r.randrange(1, len(full))
            full = r.choice([full[:i] + full[i] + full[i:], full[: i - 1] + full[i:], full])
        return (r.choice(_TITLES) if r.random() < 0.22 else "") + full

    def email(self) -> str:
        r = self.r
        who = r.choice([r.choice(GIVEN).lower() + r.choice([".", "-", "_", ""]) + r.choice(FRONT).lower() + r.choice(BACK), r.choice(FRONT).lower() + r.choice(BACK), r.choice(["ref", "post", "office", "info", "contact", "hr"])]) + str(r.randrange(1, 999999)) * (r.random() < 0.85)
        host = r.choice(_HOSTS)
        if r.random() < 0.12:
            who += f"n{r.randrange(1, 4)}"
        s = r.choice([f"{who}@{host}"] * 7 + [f"{who} (at) {host}", f"{who} [at] {host.replace('.', ' [dot] ')}", f"{who} @ {host}", f"<mailto:{who}@{host}>"])
        return r.choice([s, s, s, s, s.upper() if "mailto" not in s and "[" not in s else s, s.capitalize()])

    def address(self) -> str:
        r = self.r
        lang = r.choice([*STREETS])
        s = self.fill(r.choice(STREETS[lang]))
        if r.random() < 0.85:
            region = self.fill(r.choice(_ARABIC_REGION if lang == "ar" else _REGIONS))
            s += (" " if region.startswith("-") else "، " if lang == "ar" else ", ") + region
        return s

    def fill(self, template: str) -> str:
        r = self.r
        stem = lambda: r.choice([r.choice(_STREET_STEMS), r.choice(FRONT) + r.choice(BACK)])
        one = lambda t: re.sub(r"\{(\w+)\}", lambda m: {"n": str(r.randrange(1, 9999 if "Box" in t or "fach" in t or "ص" in t else 200)), "m": str(r.randrange(1, 40)), "a": f"{r.randrange(1, 20)}{r.choice('ABC')}", "S": stem(), "T": r.choice(_STREET_TYPES), "R": "ال" + r.choice(ARABIC_STEM) + r.choice(["", "ة", "ين"]), "c": r.choice([r.choice(self.cities), r.choice(_CITIES), r.choice(FRONT) + r.choice(BACK)]), "z": self.form("99999"), "zz": self.form("9999-999"), "d": str(r.randrange(1, 10))}[m.group(1)], t)
        return one(template)

    def slot(self, kind: str) -> tuple[str, str | None]:
        r = self.r
        return {
            "name": lambda: (self.name(), "person_name"), "email": lambda: (self.email(), "email"), "phone": lambda: (self.form(r.choice(PHONE_FORMS)), "phone"), "id": lambda: (self.form(r.choice(ID_FORMS)), "identity_number"),
            "addr": lambda: (self.address(), "street_address"), "job": lambda: (r.choice(self.jobs), None), "org": lambda: (r.choice(self.organisations), None), "p": lambda: (str(r.randrange(1, 9)), None),
        }[kind]()

    def blur(self, text: str) -> str:
        out = ""
        for c in text:
            reads = CONFUSIONS.get(c, "").split()
            out += self.r.choice(reads) if reads and self.r.random() < 0.03 else c
        return out

    def strange(self, text: str) -> str:
        """Text with some of its words replaced by words that nobody knows: an unknown word isn't a name for that alone."""
        return re.sub(r"[^\W\d_]{3,}", lambda m: m.group() if self.r.random() > 0.15 else (x := m.group()[::-1].lower()) and (x.capitalize() if m.group()[0].isupper() else x), text)

    def line(self, template: str) -> list[tuple[str, str | None]]:
        return [(x, None) if i % 2 == 0 else self.slot(x) for i, x in enumerate(re.split(r"\{(\w+)\}", template)) if x]

    def inserted(self) -> list[tuple[str, str | None]]:
        """A line of the data with an item put in anywhere, behind any word: what surrounds an item says little about it."""
        r = self.r
        words = r.choice(self.plain).split(" ")
        at = r.randrange(len(words) + 1)
        if r.random() < 0.15:
            return [(" ".join([*words[:at], self.fill(r.choice(NUMBERS)), *words[at:]]), None)]
        kind = r.choice(["name"] * 6 + ["email", "phone", "phone", "phone", "addr", "addr"])
        lead = f"{r.choice(self.words)} " * (r.random() < 0.5)
        open_, close = r.choice([("", "")] * 5 + [("(", ")"), ("(", ")"), (": ", ""), ("", ","), ("", ".")])
        return [(" ".join([*words[:at], lead]).strip() + " " * (at > 0 or bool(lead)) + open_, None), self.slot(kind), (close + " " * (at < len(words)) + " ".join(words[at:]), None)]

    def page(self, only: str | None = None) -> tuple[list[str], list[int]]:
        """Tokens and label places of one snippet of a page: a few lines that stand together; or of the one line ``only``."""
        r = self.r
        parts: list[tuple[str, str | None]] = []
        add = lambda t: parts.extend([*self.line(t), ("\n", None)])
        some = lambda most: [parts.append((r.choice(self.plain) + "\n", None)) for _ in range(r.randrange(most + 1))]
        bullet = lambda: r.choice(["", "", "- ", "• "])
        kind = "only" if only else r.choices(["top", "line", "inserted", "none", "bare", "referees", "details", "header"], [14, 18, 30, 12, 8, 8, 8, 10])[0]
        if kind not in ("top", "only"):
            some(2)
        if kind == "only":
            add(only)
        elif kind == "header":
            add(r.choice(HEADERS))
        elif kind == "top":
            if r.random() < 0.3:
                add(r.choice(HEADERS))
            add("{name}")
            add("{job}")
            contact = [r.choice(_MAIL_WORDS) + "{email}", r.choice(_PHONE_WORDS) + "{phone}", "{addr}"]
            add(r.choice(SEPARATORS).join(x for x in contact if r.random() < (0.95 if x == "{addr}" else 0.8)) or "{email}")
            parts.append(("\n", None))
        elif kind == "line":
            add(bullet() + (r.choice(self.plain) + " ") * (r.random() < 0.4) + r.choice(self.lines))
        elif kind == "inserted":
            parts += [(bullet(), None), *self.inserted(), ("\n", None)]
        elif kind == "none":
            parts.append((bullet() + self.fill(r.choice(NO_ITEMS)) + "\n", None))
        elif kind == "bare":
            add(r.choice(["{addr}", "{addr}", "{addr}", "{phone}", "{email}"]))
        elif kind == "referees":
            if r.random() < 0.6:
                add(r.choice(HEADINGS))
            for _ in range(r.randrange(1, 4)):
                add(r.choice(REFEREES))
        else:
            words = r.choice(ID_WORDS)
            form = f"{words} {{id}}"
            if r.random() < 0.5:
                add(r.choice(DETAILS))
                add(r.choice([form, form, form, "{addr}", words + "\n{id}"]))
            else:
                add(f"{r.choice(self.plain).rstrip('.')} ({form}).")
        if kind != "only":
            some(2)
        if r.random() < 0.1 and kind != "only":
            parts.append((r.choice(["[{}]", "p. {}", "- {} -", "Page {} of 3", "{}/4", "{}"]).format(r.randrange(1, 5)) + "\n", None))
        if r.random() < 0.3:
            parts = [(self.strange(t) if k is None else t, k) for t, k in parts]
        noisy = r.random() < 0.25
        wrap = r.choice([0, 0, 60, 72])
        tokens, labels = [], []
        column = 0
        for text, kind in parts:
            if noisy and (kind is None or r.random() < 0.5):
                text = self.blur(text)
            begun = False
            for m in TOKEN.finditer(text):
                w = m.group()
                if w == "\n":
                    column = 0
                elif wrap and column + len(w) > wrap:
                    tokens.append("\n")
                    labels.append(LABELS.index(f"I-{kind}") if begun else 0)
                    column = 0
                column += len(w) + 1
                tokens.append(w)
                mark = kind and not (not begun and w in "<(")
                if kind == "email" and w == "mailto":
                    mark = False
                if kind == "email" and not begun and w == ":":
                    mark = False
                if kind == "person_name" and not begun and any(text.startswith(t) and m.start() < len(t) for t in _TITLES):
                    mark = True
                labels.append(LABELS.index(f"{'I' if begun else 'B'}-{kind}") if mark else 0)
                begun = begun or bool(mark)
        return tokens, labels
