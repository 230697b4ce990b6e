"""Personal data in free text, found by boosted trees over candidate spans and replaced by placeholders.

High-recall generators propose overlapping spans of five kinds; each span gets a tuple of small numbers that
describe its format and its surroundings; one ensemble of boosted trees per kind, trained on generated and
labelled sentences (``personal_training``), scores it against a threshold calibrated on held-out ones.  Of
overlapping spans the surest wins.  The trees are fitted beforehand and lie in a versioned file (``TREES``), which the
driver reads and sends to the workers.

Every stretch of two to four neighbouring capitalised words is proposed as a name (in Latin, Greek and Cyrillic
letters), also one with words that hardly ever belong to names: such words are a feature and exclude nothing.  Names in
lower case are proposed behind words that announce one, Hangul and Han names before a title.

``redact`` replaces the spans of a plain text.  ``redact_json`` does so in every string value of a JSON
text, at any depth, and leaves every other byte as it is, so that valid JSON stays valid; a text that is cut short
is treated up to its end.  Member names are not text.

Defined results: null stays null, an empty text stays empty, both without findings; very long texts are
taken whole; repeated rows are treated alike; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

from braidlog.functions.jsontext import LITERAL

TREES = "personal_trees_v2.json"
KINDS = ("email", "phone", "id_number", "address", "person")
PLACEHOLDER = {k: f"[{k.upper()}]" for k in KINDS}

# Common given names of the four languages, without accents, in lower case.
GIVEN = frozenset(
    "adam adele adrian alain alba albert alberto alejandro alex alice alicia alvaro amelie ana andrea andreas andres andrew angela anna anne "
    "annegret antoine antonio arthur barbara beatriz benjamin benoit bernd birgit bjorn brigitte camille carla carlos carmen caroline catherine "
    "celine charles charlotte chloe christian christine claire claude claudia daniel david diego edward elena elisabeth elizabeth elodie emilia "
    "emily emma enrique eric etienne eva fabian felix fernando florian francisco francois frank gabriel george grace guillaume gunter hannah hans "
    "heike heinrich helen helene henry ignacio ines ingrid irene isabel isabelle jack jacques james jan jane javier jean jennifer jessica joaquin "
    "johanna john jonas jorge jose joseph juan julia julie julien jurgen karin karl kathe katharina kevin klaus lars laura laurent lea lena leon "
    "linda louis louise lucas lucia luis lukas manon manuel margarita maria marie mark marta martin mary mathieu matthias michael michel miguel "
    "monika natalie nicolas nina noelia nora oliver olivia pablo paul pedro peter philippe pierre pilar rachel raquel rebecca richard robert rosa "
    "ruben ruth sabine samuel sandra sara sarah sebastian sergio silvia simon sofia sophie stefan stephanie susanne sven sylvie teresa thierry "
    "thomas tobias ulrich ulrike ursula uwe victor vincent walter werner william wolfgang yolanda".split()
)

# Words that are seldom part of a name, capital letter or not (a feature of the trees).
NO_NAME = frozenset(
    "the a an this that these those it its in on at by for from to of and or but if so as is are was be do does did can could we you i he she they my our your his her after before once under strictly "
    "please show how why what when where which who done two here short sorry right only see release run ticket host trace pinned line page section note total budget error warn warning info debug result user assistant "
    "system task tool agent file table column row server client service daemon jobs job pool queue index cache key value type name date time monday tuesday wednesday thursday friday saturday sunday january february march "
    "april may june july august september october november december english german french spanish "
    "der die das den dem des ein eine einen einem einer eines und oder aber nicht im in am an auf aus bei mit nach von vor zu zum zur wie was wer wo warum wann ich wir du sie er es ihr mein meine unser unsere dein diese dieser dieses "
    "ask thanks thank regards cheers dear hello hi hey author owner cc forward according call text write my best saludos hola gracias segun autor laut gruße gruesse viele hallo danke frag bearbeiter herr frau merci bonjour selon auteur demande monsieur madame "
    "kannst bitte noch danach zuerst zwei hier laut viele wenn kurz unter erledigt "
    "le la les l un une des du de et ou mais ne pas en dans sur au aux par pour avec sans sous ce cette ces il elle on nous vous tu je mon ma mes notre votre son sa ses comment pourquoi quand peux merci ensuite encore "
    "el los las una unos unas y o pero no con por para sin sobre este esta estos estas yo mi mis nuestro nuestra tu tus su sus como cuando donde quiero puedes despues otra ahora hay lo al del".split()
)

EMAIL_AT = r"(?:@|\s?[\[({<]\s?(?:at|@|ät|arroba|arobase)\s?[\])}>]\s?|\s(?:at|ät|arroba|arobase|klammeraffe)\s)"
EMAIL_DOT = r"(?:\.|\s?[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]\s?|\s(?:dot|punkt|point|punto)\s)"
EMAIL = re.compile(
    rf"(?<![\w.+%-])(?:mailto:)?[^\W_][\w.+%'-]*(?:(?:@|\s?[\[({{<]\s?(?:at|@|ät|arroba|arobase)\s?[\])}}>]\s?)[^\W_][\w-]*(?:{EMAIL_DOT}[^\W_][\w-]*)+"
    rf"|\s(?:at|ät|arroba|arobase|klammeraffe)\s[^\W_][\w-]*(?:\s?[\[({{<]?\s?(?:dot|punkt|point|punto)\s?[\])}}>]?\s[^\W_][\w-]*)+)",
    re.IGNORECASE,
)
MAYBE_EMAIL = re.compile(r"@|[\[({<]\s?(?:at|ät|arroba|arobase)\b|\s(?:at|ät|arroba|arobase|klammeraffe)\s\S+\s?[\[(]?\s?(?:dot|punkt|point|punto)\b", re.IGNORECASE)
NUMBER = re.compile(r"(?<![\w.+])(?:\+|\()?\d(?:[ \u00a0./()–-]{0,2}\d){6,18}(?![\w]|[.,]\d|[ -]?[A-Z]\b)(?:\s?(?:ext\.?|x|extension|durchwahl|poste)\s?\d{1,5}\b)?", re.IGNORECASE)
LETTERED = re.compile(r"(?<![\w.-])(?:[A-Z]{6}\d{2}[A-EHLMPR-T]\d{2}[A-Z]\d{3}[A-Z]|[XYZ]?-?\d{7,8}[ -]?[A-Z]|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|[A-Z][A-Z0-9]{2} ?\d{6}\d?|[A-Z]\d{8})(?![\w-])")

# Kinds of streets.
STREET_EN = r"(?:Street|St|Lane|Ln|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Way|Place|Pl|Boulevard|Blvd|Terrace|Close|Crescent|Square|Row|Hill|Walk|Parkway|Pkwy|Highway|Hwy|Circle|Cir|Trail|Mews)"
STREET_DE = r"(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|damm|ufer|steig|pfad|chaussee|markt|graben|hof|straat|laan|plein|gracht|kade)"
STREET_FR = r"(?:rue|avenue|av\.|boulevard|bd|allée|allee|chemin|impasse|place|quai|cours|route|passage|square|sentier|villa|faubourg|esplanade)"
STREET_ES = r"(?:calle|c/|avenida|avda\.?|av\.|plaza|paseo|camino|carretera|ronda|travesía|glorieta|callejón|pasaje|rambla|vía|urbanización|via|viale|piazza|corso|vicolo|largo|rua|travessa|praça|alameda)"
CAP = r"[A-ZÀ-ÞĀ-Ž][\w’'-]*"
ADDRESS = {
    "en": re.compile(rf"\b\d{{1,5}}[A-Za-z]?,? (?:[NSEW]\.? )?{CAP}(?: {CAP}){{0,3}} {STREET_EN}\b\.?(?:,? (?:Apt|Unit|Suite|Ste|Flat|Floor|#)\.? ?\w+)?(?:,? {CAP}(?: {CAP}){{0,2}},?(?: [A-Z]{{2}})? \d{{5}}(?:-\d{{4}})?|,? {CAP}(?=[.,\"\n]|$))?"),
    "de": re.compile(rf"\b(?:{CAP}{STREET_DE}|{CAP}(?:[ -]{CAP})*[ -](?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Damm|Ufer)|(?:Am|An der|Im|Auf dem|Zum|Zur|Unter den) {CAP}) \d{{1,4}} ?[a-z]?\b(?:,? \d{{5}} {CAP}(?:[ -]{CAP})*)?"),
    "fr": re.compile(rf"\b\d{{1,4}}(?: ?(?:bis|ter|quater|[A-D]))?,? (?i:{STREET_FR})(?: (?:de|du|des|d[’']|la|le|les|aux?|l[’']|à|en|sur|sous|et|{CAP})[’']?)*(?: ?{CAP})+(?:,? \d{{5}} {CAP}(?:[ -]{CAP})*)?"),
    "es": re.compile(rf"(?<!\w)(?i:{STREET_ES})(?: (?:de|del|la|las|el|los|y|da|das|do|dos|della|delle|dei|{CAP}))*,? (?:n\.? ?[º°o]\.? ?|núm\. ?|número )?\d{{1,4}}\b(?:,? \d{{1,2}}(?:\.?[º°ª] ?\w{{0,4}}\.?| ?[A-Z]\b))?(?:,? \d{{5}} {CAP}(?:[ -]{CAP})*)?"),
}
#: What a text must hold for a German or Spanish address (fixed values).
MUST = {
    "de": ("straße ", "strasse ", "str. ", "weg ", "gasse ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "pfad ", "chaussee ", "markt ", "graben ", "hof ", "straat ", "laan ", "plein ", "gracht ", "kade ", "am ", "an der ", "im ", "auf dem ", "zum ", "zur ", "unter den "),
    "es": ("calle", "c/", "avenida", "avda", "av.", "plaza", "paseo", "camino", "carretera", "ronda", "travesía", "glorieta", "callejón", "pasaje", "rambla", "vía", "urbanización", "via", "piazza", "corso", "vicolo", "largo", "rua", "travessa", "praça", "alameda"),
}
DIGIT = re.compile(r"\d")
NAME = r"[A-ZÀ-ÞĀ-Ž][a-zß-ÿā-ž’']+(?:-[A-ZÀ-Þ][a-zß-ÿ’']+)?|[A-ZÀ-ÞĀ-Ž]{2,}(?:-[A-ZÀ-Þ]{2,})?|(?:O’|O'|Mc|Mac|D’|d’|D'|d')[A-Z][a-z]+|[А-ЯЁІЇЄ][а-яёіїє]+(?:-[А-ЯЁ][а-яё]+)?|[Α-ΩΆΈΉΊΌΎΏ][α-ώ]+"
PERSON = re.compile(rf"(?<![\w`/._-])(?:{NAME})(?:(?:,? [A-Z]\.)?(?:,? (?:van|von|de|del|della|di|du|der|den|la|le|zu|da|dos|y)(?: (?:la|las|los|der|den))?)?,? (?:{NAME})){{1,7}}(?![\w`/_]|-\w)")
#: Names in lower case behind an announcing word, and names before a title in Hangul or Han.
LOWER = re.compile(r"\b[AaBbCcDdFfGgHhMmOoTt](?:sk|c|wner|uthor|hanks|ontact|i|ello|ear|rag|allo|anke|erci|onjour|emande|ola|racias)[:,]? ([a-zß-ÿ]+ [a-zß-ÿ]{3,})(?![\w@/])")
TITLED = re.compile(r"[가-힣]{2,4}(?= ?(?:씨|님|선생님|대리님|과장님|부장님|팀장님))|[\u4e00-\u9fff]{2,4}(?:[ ・][\u4e00-\u9fff]{1,3})?(?=さん|様|先生|女士)")
TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?")

# Words near a span that speak for or against a kind.
CUE_PHONE = re.compile(r"(?i)\b(?:phone|tel|telephone|telefon|téléphone|telefono|teléfono|tfno|mobile|mobil|móvil|portable|cell|call|fax|text|whatsapp|sms|ring|ruf|anruf|erreich\w*|nummer|appelle|appeler|joindre|numéro|llám\w*|llama|on-call|hotline|dial|astreinte|guardia|bereitschaft|rufnummer|durchwahl|contact)\b|user_phone|phone[\"'=:]|tel[\"'=:]")
CUE_ID = re.compile(
    r"\b(?:DNI|NIE|NIF|NIR|NINO|TIN|ITIN|INSEE|NUSS|SVNR|CPF|CNPJ|BSN|PESEL|CURP|[Cc]odice(?: fiscale)?|Aadhaar)\b|(?i:\b(?:ssn|social security|tax id|identity (?:no|number|card)|id (?:card|number|no)|national (?:id|insurance)|passport|personalausweis\w*|ausweis\w*|steuer-?id\w*|steuernummer|identifikationsnummer|"
    r"sozialversicherung\w*|rentenversicherung\w*|documento|identidad|seguridad social|insee|sécurité sociale|securite sociale|carte (?:nationale )?d.identité|num[ée]ro fiscal|n° ?ss|identité|pasaporte|passeport|reisepass\w*)\b|ssn[\"'=:_])"
)
CUE_NOT_NUMBER = re.compile(r"(?i)\b(?:checksum|prüfsumme|crc|hash|sha\d*|md5|run|build|release|version|ticket|trace|bucket|offset|line|zeile|ligne|línea|rows?|filas|lignes|zeilen|batch|lote|lot|stapel|port|pid|inode|bytes?|retries|ms|commit|issue|order|isbn|invoice no|job|epoch|timestamp|ts|row_id|count|total|size|seed|uuid|position|serial|ean|sku|number of|exit code|port|build)\b\W*(?:\w+\W+){0,2}$")
CUE_PERSON = re.compile(r"(?i)(?:\b(?:colleague|coworker|co-owner|owner|author|autor|auteur|bearbeiter(?:in)?|reviewed-by|reviewer|signed-off-by|co-authored-by|cc|by|ask|asked|thanks|thank you|regards|cheers|best|hi|hello|dear|hey|according to|assigned to|told|from|contact|mr|mrs|ms|dr|prof|herr|frau|kolleg(?:e|in)|laut|frag(?: bitte)?|grüße|gruß|hallo|lieber|liebe|danke|monsieur|madame|mme|collègue|selon|demande|d.après|à|bonjour|merci|cordialement|assigné à|señora?|sra?|don|doña|compañer[oa]|según|pide|saludos|hola|gracias|asignad[oa] a|revisión a|name|user|customer|employee|tester|call|in der besprechung|mit|with|avec|con|de|von|para|for|relecture à|responsable|zuständig|verantwortlich|contacto|kontakt|assignee|approver|maintainer|manager|reporter|sender|recipient)\b[\"'=:,]*\s*[\"']?|-- ?\n|\|\s|<)$")
CUE_PERSON_AFTER = re.compile(r"(?i)^(?:\s*<|\s*\|\s|,?\s*\n|\"|[,;]? (?:and \w+ others|told|said|wrote|says|thinks|asked|reported|agreed|will|has|meint|sagt|sagte|hat|schrieb|schreibt|fragt|und|m[’']a|a (?:écrit|dit)|dit|pense|et|dijo|me dijo|dice|escribió|opina|y|ha|can|is|was)\b)")


def plain(word: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c)).rstrip(".")


def _digits(s: str) -> str:
    return re.sub(r"\D", "", s)


def _dni_ok(s: str) -> bool:
    m = re.fullmatch(r"([XYZ]?)-?(\d{7,8})[ -]?([A-Z])", s)
    return bool(m) and "TRWAGMYFPDXBNJZSQVHLCKE"[int({"X": "0", "Y": "1", "Z": "2"}.get(m[1], "") + m[2]) % 23] == m[3]


def _email_features(text: str, a: int, b: int) -> tuple:
    s = text[a:b]
    at = re.search(EMAIL_AT, s, re.IGNORECASE)
    local, domain = s[: at.start()], s[at.end() :]
    last = re.split(EMAIL_DOT, domain, flags=re.IGNORECASE)[-1]
    return (
        int("@" in at.group()),
        int(any(c in at.group() for c in "[({<")),
        int(last.isalpha()) + int(last.isalpha() and len(last) >= 2),
        min(3, len(re.findall(r"[^\W\d_]", local))),
        int(text[b : b + 1] == ":" and text[b + 1 : b + 2] not in (" ", "\n", "")) + 2 * int(text[b : b + 1] == "/"),
        int(domain[:1].isdigit()),
        int(text[max(0, a - 3) : a] == "://"),
        int(bool(re.search(r"[\[({]\s?(?:dot|punkt|point|punto)|\s(?:dot|punkt|point|punto)\s", s, re.IGNORECASE))),
    )


def _number_features(text: str, a: int, b: int) -> tuple:
    """Shared by phones and identity numbers."""
    s = text[a:b]
    core = re.split(r"(?i)\s?(?:ext|x|durchwahl|poste)", s)[0]
    d = _digits(core)
    groups = [len(g) for g in re.findall(r"\d+", core)]
    before, after = text[max(0, a - 45) : a], text[b : b + 25]
    line = before.rsplit("\n", 1)[-1]
    shape = 0
    if re.fullmatch(r"\d{3}[- ]\d{2}[- ]\d{4}", s):
        shape = 1
    elif re.fullmatch(r"[12] ?\d{2} ?\d{2} ?(?:\d{2}|2[AB]) ?\d{3} ?\d{3}(?: ?\d{2})?", s):
        shape = 2
    elif re.fullmatch(r"(?:19|20)\d{2}[-./ ]\d{1,2}[-./ ]\d{1,2}.*|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d{2}", s):
        shape = 3
    elif re.fullmatch(r"(?:\d{1,3}\.){3}\d{1,3}", s):
        shape = 4
    elif re.fullmatch(r"(?:\+|00)[\d ()./–\u00a0-]+.*", s):
        shape = 5
    elif re.fullmatch(r"\(?\d{3}\)?[ .-]?\d{3}[ .-]\d{4}.*", s):
        shape = 6
    elif re.fullmatch(r"0\d(?:[ .-]?\d{2}){4}", s):
        shape = 7
    elif re.fullmatch(r"\(?0\d{1,4}\)?[ /-]?\d[\d /-]{4,}", s):
        shape = 8
    elif re.fullmatch(r"[6789]\d{2}(?:[ .-]?\d{3}){2}|[6789]\d{2}(?:[ .-]?\d{2}){3}", s):
        shape = 9
    elif re.fullmatch(r"\d{2} \d{3} \d{3} \d{3}", s):
        shape = 10
    elif re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}", s):
        shape = 12
    elif re.fullmatch(r"\d{4}[ -]\d{4}[ -]\d{4}", s):
        shape = 13
    elif len(groups) == 1:
        shape = 11
    valid = int(shape == 2 and len(d) == 15 and int(d[13:]) == 97 - int(d[:13]) % 97)
    return (
        shape,
        min(16, len(d)),
        min(5, len(groups)),
        int(bool(CUE_PHONE.search(before)) or bool(re.match(r"(?i)[^\n.]{0,12}\b(?:anrufen|an,|anrufe|phone)\b", after))),
        int(bool(CUE_ID.search(before)) or bool(re.match(r"(?i)[^\n.]{0,14}\b(?:ssn|identity|tax|dni|ausweis)\b", after))),
        int(bool(CUE_NOT_NUMBER.search(line))),
        int(d[:1] == "0") + 2 * int(d[:2] == "00"),
        int("(" in s),
        int(len(d) == 9 and (d[:3] in ("000", "666") or d[0] == "9")),
        valid,
        int(text[a - 1 : a] in ("", "\n", " ", '"', "=", ":", "(", "|", "<")) + int(text[b : b + 1] in ("", "\n", " ", '"', ",", ".", ";", ")", "|", "?", "!")),
        int(not line.strip() and after[:1] in ("", "\n")),
        int(bool(re.search(r"\|\s*$", before))) + int(bool(re.search(r"[@\]][^|\n]*\|\s*$", before))),
    )


def _lettered_features(text: str, a: int, b: int) -> tuple:
    s = text[a:b]
    before, after = text[max(0, a - 45) : a], text[b : b + 25]
    shape = 0
    if re.fullmatch(r"[XYZ]-?\d{7}[ -]?[A-Z]", s):
        shape = 1
    elif re.fullmatch(r"\d{8}[ -]?[A-Z]", s):
        shape = 2
    elif re.fullmatch(r"[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?\d{2} ?\d{2} ?\d{2} ?[A-D]", s):
        shape = 3
    elif re.fullmatch(r"[CFGHJKLMNPRTVWXYZ][A-Z0-9]{2} ?\d{6}\d?", s):
        shape = 4
    elif re.fullmatch(r"[A-Z]\d{8}", s):
        shape = 5
    elif re.fullmatch(r"[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z]", s):
        shape = 6
    return (shape, int(_dni_ok(s)), int(bool(CUE_ID.search(before)) or bool(re.match(r"(?i)[^\n.]{0,14}\b(?:ssn|identity|tax|dni|ausweis)\b", after))), int(bool(CUE_NOT_NUMBER.search(before.rsplit("\n", 1)[-1]))), int(" " in s or "-" in s), int(sum(c.isdigit() for c in s) >= 7))


def _address_features(text: str, a: int, b: int, kind: str) -> tuple:
    s = text[a:b]
    before = text[max(0, a - 40) : a]
    return (
        ("en", "de", "fr", "es").index(kind),
        int(bool(re.search(r"\d{5}", s))),
        int(bool(re.search(r"(?:Apt|Unit|Suite|Flat|bis|ter|[º°])", s))),
        int(bool(re.search(r"(?i)\b(?:live|lives|address|addr|home|office|ship|send|deliver|moved|invoice|wohne|wohnt|adresse|schick|liefer|rechnung|büro|habite|envoie|livre|facture|bureau|adresse|vivo|vive|dirección|envía|entrega|factura|oficina)\b|home_address|addr[\"'=:]", before))),
        int(bool(re.search(r"(?i)\b(?:line|section|page|step|version|release|file|chapter|port|schritt|seite|zeile|kapitel|étape|ligne|section|chapitre|paso|página|línea|sección|capítulo)\W+$", before))),
        int(before.rsplit("\n", 1)[-1].strip() == ""),
        int("`" in text[a:b] or "_" in s or "/" in s.replace("c/", "").replace("C/", "")),
        int(kind == "de" and bool(re.search(rf"\w{{3,}}{STREET_DE} \d", s))) + int(kind == "de" and bool(re.match(r"(?:Am|An|Im|Auf|Zum|Zur|Unter)\b", s))) * 2,
    )


PARTICLE = re.compile(r"(?:[A-Z]\.|van|von|de|del|della|di|du|der|den|la|le|zu|da|dos|y|las|los)")
STREET_WORD = re.compile(rf"\b{STREET_EN}\b|(?i:{STREET_DE})\b")
ARTICLE = re.compile(r"(?i)\b(?:the|a|an|this|der|die|das|den|dem|ein|eine|le|la|les|un|une|el|los|las|una)\s$")
BEGIN = re.compile(r"[.!?…:]\s+$|\n\s*$|[\"“„«(]\s*$")


JOINED = (" and ", " und ", " et ", " y ", " e ", " & ")
OTHER_BEFORE = re.compile(r"([^\W\d_]+)(?: [^\W\d_]+){1,2},? \S+ $")
OTHER_AFTER = re.compile(r"^ \S+ ([^\W\d_]+) [^\W\d_]")


def _joined(text: str, a: int, b: int) -> int:
    """Whether "and" joins the span to other capitalised words (1), and these begin with a common given name (2)."""
    m = None
    if text.startswith(JOINED, b):
        m = OTHER_AFTER.match(text[b : b + 40])
    elif text[max(0, a - 5) : a].endswith(JOINED):
        m = OTHER_BEFORE.search(text[max(0, a - 45) : a])
    if not m or not m[1][:1].isupper():
        return 0
    return 2 if plain(m[1]) in GIVEN else 1


def _person_features(text: str, a: int, b: int, left: int = 0, right: int = 0, kind: int = 0) -> tuple:
    """``left``, ``right``: the neighbouring word of the run (0 none, 1 a capitalised one, 2 one seldom in names)."""
    s = text[a:b]
    words = [w for w in TOKEN.findall(s) if not PARTICLE.fullmatch(w)]
    low = [plain(w) for w in words]
    given = [w in GIVEN or ("-" in w and not GIVEN.isdisjoint(w.split("-"))) for w in low]
    before, after = text[max(0, a - 30) : a], text[b : b + 24]
    caps = [len(w) > 1 and w.isupper() for w in words]
    start = not before.strip() or bool(BEGIN.search(before))
    seldom = [w in NO_NAME for w in low]
    return (
        int(given[0]) + 2 * int(given[-1]),
        min(4, len(words)),
        int(bool(re.search(r"\b[A-Z]\.", s))),
        int(any(caps)) + int(all(caps)),
        int("," in s),
        int("-" in s),
        int(bool(CUE_PERSON.search(before))),
        int(bool(CUE_PERSON_AFTER.search(after))),
        int(start),
        int(bool(ARTICLE.search(before))),
        int(bool(STREET_WORD.search(s))),
        int(not before.rsplit("\n", 1)[-1].strip() and after[:1] in ("", "\n", ",")),
        int(seldom[0]) + 2 * int(any(seldom[1:])),
        left,
        right,
        kind,
        _joined(text, a, b),
    )


Span = tuple[int, int, str, tuple, str]  # start, stop, kind, features, ensemble


def _names(text: str, a: int, b: int) -> Iterator[tuple[int, int, int, int]]:
    """All stretches of two to four capitalised words of a run, with what their neighbours in the run are."""
    run = [m for m in TOKEN.finditer(text, a, b)]
    full = [i for i, m in enumerate(run) if m.group()[:1].isupper() and len(m.group().rstrip(".")) > 1]
    side = [2 if plain(run[i].group()) in NO_NAME else 1 for i in full]
    for x in range(len(full)):
        for y in range(x + 1, min(x + 4, len(full))):
            yield run[full[x]].start(), run[full[y]].end(), side[x - 1] if x else 0, side[y + 1] if y + 1 < len(full) else 0


def candidates(text: str) -> Iterator[Span]:
    """Overlapping spans that may be personal data, with their features."""
    if MAYBE_EMAIL.search(text):
        for m in EMAIL.finditer(text):
            yield m.start(), m.end(), "email", _email_features(text, *m.span()), "email"
    for m in NUMBER.finditer(text):
        a, b = m.span()
        if text[a] == "(" and ")" not in text[a:b]:
            a += 1
        f = _number_features(text, a, b)
        yield a, b, "phone", f, "phone"
        yield a, b, "id_number", f, "number"
    for m in LETTERED.finditer(text):
        yield m.start(), m.end(), "id_number", _lettered_features(text, *m.span()), "lettered"
    if DIGIT.search(text):
        low = text.lower()  # once for all patterns
        for lang, pattern in ADDRESS.items():
            if lang not in MUST or any(k in low for k in MUST[lang]):
                for m in pattern.finditer(text):
                    yield m.start(), m.end(), "address", _address_features(text, *m.span(), lang), "address"
    for m in PERSON.finditer(text):
        kind = int(text[m.start()] > "ɏ")
        for a, b, left, right in _names(text, *m.span()):
            yield a, b, "person", _person_features(text, a, b, left, right, kind), "person"
    for m in LOWER.finditer(text):
        if plain(m.group(1).split(" ")[0]) in GIVEN:
            yield m.start(1), m.end(1), "person", _person_features(text, *m.span(1), 0, 0, 2), "person"
    if not text.isascii():
        for m in TITLED.finditer(text):
            yield m.start(), m.end(), "person", _person_features(text, *m.span(), 0, 0, 3), "person"


class Finder:
    """Personal data of a text, by the trees of each kind."""

    def __init__(self, trees: dict) -> None:
        self.trees = trees

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Chosen spans in order; of overlapping ones the surest, then the longest."""
        sure = []
        for a, b, kind, f, name in candidates(text):
            t = self.trees[name]
            s = t.score(f)
            if s >= t.threshold:
                sure.append((-s, a - b, a, b, kind))
        if not sure:
            return []
        sure.sort()
        out: list[tuple[int, int, str]] = []
        for _, _, a, b, kind in sure:
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, kind))
        return sorted(out)

    def redact(self, text: str | None) -> tuple[str | None, list[str]]:
        if not text:
            return text, []
        found = self.spans(text)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, kind in found:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
        return "".join([*out, text[at:]]), [k for *_, k in found]

    def redact_json(self, text: str | None) -> tuple[str | None, list[str]]:
        if not text:
            return text, []
        out, at, kinds = [], 0, []
        for m in LITERAL.finditer(text):
            raw = m.group(1)
            if m.group(2) == '"' and re.match(r"\s*:", text[m.end() : m.end() + 20]):
                continue  # a member's name
            plain_text, places = decode(raw)
            found = self.spans(plain_text)
            for a, b, kind in found:
                x, y = m.start(1) + places(a), m.start(1) + places(b)
                out += [text[at:x], PLACEHOLDER[kind]]
                at = y
                kinds.append(kind)
        return "".join([*out, text[at:]]), kinds


ESCAPE = re.compile(r"\\(?:u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|u[0-9a-fA-F]{0,3}|.)?", re.DOTALL)


def decode(raw: str):
    """The text of a string literal, and the function from its offsets to those in ``raw``."""
    if "\\" not in raw:
        return raw, lambda i: i
    out, marks, at, size = [], [(0, 0)], 0, 0
    for m in ESCAPE.finditer(raw):
        out.append(raw[at : m.start()])
        size += m.start() - at
        e = m.group()
        try:
            c = json.loads(f'"{e}"')
        except ValueError:
            c = "�"
        out.append(c)
        marks.append((size, m.start()))
        size += len(c)
        at = m.end()
        marks.append((size, at))
    out.append(raw[at:])

    def place(i: int) -> int:
        from bisect import bisect_right

        k = bisect_right(marks, (i, len(raw) + 1)) - 1
        return marks[k][1] + i - marks[k][0]

    return "".join(out), place
