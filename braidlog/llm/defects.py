"""Prompt and response pairs that are broken, with the kind of defect.

Each answer is judged in this order, and the first that holds is its defect:

``empty``          nothing is said: no letter or digit, or only a placeholder for nothing;
``copied``         greedy string tiling covers nearly all words of the answer with tiles of the prompt, and
                   nearly all of the prompt with the answer; answers too short for a tile are compared as a whole;
``refusal``        every sentence is a refusal, or a courtesy beside one, in a small grammar per language;
``other_language`` script and function words show another language than the prompt's, and no other was asked for;
``truncated``      a pushdown parser over the whole answer (fences, code spans, brackets, straight and curly
                   quotations, lists, tables and markup) ends with something open, or the last sentence or
                   list item has no end.

How list items end is learned from the words of all answers: which words occur within items but hardly ever end
one, and the vocabulary, so that a word cut in the middle is known.  The counts are added up in the tasks first;
words below the share ``KNOWN`` are left out, so at most 1 / ``KNOWN`` words reach the driver whatever the corpus.

Defined results: a null or empty answer is ``empty``, whatever the prompt; a null prompt can't be copied or
have a language; equal exchanges get equal verdicts; other columns are ignored; an empty table gives no rows;
texts of any length and any repetition are judged whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidlog.functions.arrow import map_rows
from braidlog.session import cut

#: Shares of all words in list items from which a word is known, and common enough to judge how it ends items by;
#: a word also needs that many occurrences, without which a share says nothing.
KNOWN, COMMON, KNOWN_LEAST, COMMON_LEAST = 1e-5, 7e-5, 3, 20
WORD = re.compile(r"[^\W_]+")
TICKS = re.compile(r"(`{3,}|~{3,})")
SPAN = re.compile(r"`[^`\n]*`")
ITEM = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+(.*)$")
MARKER = re.compile(r"(?i)(?:\[\s*(?:…\s*)?truncated\s*(?:…\s*)?\]|\(truncated\)|<truncated>)\W*$")

# Texts that stand for nothing.
NOTHING = {
    "n a", "na", "nil", "null", "none", "undefined", "nan", "empty", "blank", "void", "no content", "no response", "no answer", "no output", "no reply", "no text",
    "kein inhalt", "keine antwort", "keine ausgabe", "leer", "sin contenido", "sin respuesta", "vacío", "ninguno", "aucun contenu", "aucune réponse", "pas de réponse",
    "sans réponse", "sans contenu", "vide", "tbd", "todo", "placeholder", "empty response", "empty message", "response missing", "missing", "not available",
}

# Function words by language.
FUNCTION = {
    "en": "the a an of and to in is it that for on with as this was by are be at from or not have has which you we they will would can so if when what there their but your our i my me he she do does did how why while because before after once since than then only no",
    "de": "der die das und ist in den von zu mit sich des auf für nicht ein eine einen einem einer dem es an werden aus er hat dass sie nach bei um am sind noch wie über so zum zur war haben nur oder aber vor bis mehr durch man dann wir ich du mir was kann muss unser unsere diese dieser dieses ohne weil wenn auch im vom während obwohl also bitte zwischen wo warum",
    "fr": "le la les de des du un une et est en à il elle que qui dans pour pas sur au aux avec par ce cette ces se ne plus ou mais nous vous je tu on son sa ses leur être été sont sans si même parce quand comme tout tous toute puis donc sous entre chaque après avant notre votre mon ma l d n qu c j m s y où comment pourquoi",
    "es": "el la los las de del un una y es en que por para con no se su sus al lo como más pero o este esta estos estas sin sobre entre cuando también hay fue ser son ya si porque aunque mientras cada tras nuestro nuestra mi yo tú él ella qué cómo cuál dónde hasta desde antes después solo otra vez",
    "it": "il lo gli di del della dei delle dello che è non per un una con come più anche questo questa nel nella alla sono ma o se si ha ho hanno perché quando dove ancora già fino dopo prima senza tra fra ogni essere stato nostro vostro loro cosa poi quindi mentre dal dalla sul sulla e",
    "pt": "o os as um uma do da dos das no na nos nas em ao à pelo pela que é não por para com como mais mas ou se está são foi ser isso este esta já também quando porque onde depois antes sem entre cada nosso nossa você eu ele ela seu sua até ainda então e",
    "nl": "de het een en van in is dat op te voor met niet zijn aan er ook als maar om bij nog uit dan naar heeft hebben wordt worden deze dit die ik je wij we zij hij wat kan moet geen door over tot omdat wanneer waar hoe na zonder tussen elke onze mijn",
}
#: Languages whose word lists weigh against each other; the others count in full only for words none of these has.
MAIN = ("en", "de", "fr", "es")
#: word -> its weight for each language; a word of several languages says less.
WEIGHTS: dict[str, dict[str, float]] = {}
for _lang, _words in FUNCTION.items():
    for _w in _words.split():
        _by = WEIGHTS.setdefault(_w, {})
        _by[_lang] = 0.3 if _lang not in MAIN and _by else 1.0
for _w, _by in WEIGHTS.items():
    if sum(k in MAIN for k in _by) > 1:
        WEIGHTS[_w] = dict.fromkeys(_by, 0.3)
#: Names of languages in several languages, for requests to answer in another (fixed values).
LANGUAGES = re.compile(
    r"(?i)\b(english|german|french|spanish|italian|portuguese|dutch|russian|polish|chinese|japanese|korean|arabic|greek|turkish|hindi|ukrainian|"
    r"englisch\w*|deutsch\w*|französisch\w*|spanisch\w*|italienisch\w*|portugiesisch\w*|russisch\w*|"
    r"anglais\w*|allemand\w*|français\w*|espagnol\w*|italien|portugais|"
    r"inglés|alemán|francés|español|castellano|italiano|portugués|translat\w*|übersetz\w*|tradui\w*|traduc\w*|traduzc\w*)\b"
)

# The grammar of refusals and of courtesies beside them.  A name in angle brackets stands for its
# productions, ``~n`` for at most n characters of anything; all else is a regular expression over lower case.
GRAMMAR: dict[str, dict[str, list[str]]] = {
    "en": {
        "WE": ["i", "we"],
        "AM": [" am", "'m", " are", "'re"],
        "CANNOT": ["can ?not", "can't", "could ?n[o']t", "won't", "will not", "would not", "wouldn't", "may not", "must not"],
        "ACT": "help assist provide do write answer discuss share comply fulfil\\w* carry complete support give create produce generate continue engage offer go take respond process disclose perform make talk handle proceed accept satisfy explain say tell work act agree".split(),
        "BARRED": ["unable", "not able", "not allowed", "not permitted", "not in a position", "not comfortable", "not authori[sz]ed", "not willing", "prohibited", "forbidden"],
        "OBLIGED": ["must", "have to", "need to", "will have to", "ought to", "going to have to", "i'd rather", "obliged to", "forced to"],
        "TURN_DOWN": ["decline", "refuse", "pass", "turn (?:it |this |that |you )?down", "say no", "reject"],
        "CODE": ["guidelines", "polic\\w+", "rules", "principles", "instructions"],
        "REFUSAL": [
            r"\b<WE>\b~30\b<CANNOT>\b(?: be able to)?~20\b<ACT>\b(?! \w+ing\b)", r"\b<WE><AM>(?: \w+)? <BARRED>\b", r"\b<WE> (?:do not|don't) (?:feel )?(?:comfortable|able|have permission)",
            r"\b<OBLIGED> (?:\w+ )?<TURN_DOWN>\b", r"\bi (?:\w+ )?(?:decline|refuse)\b", r"\bi(?:'d| would)? (?:rather|prefer) not\b", r"\bi(?:'d| would) prefer not\b",
            r"\bagainst (?:the |my |our |any )?(?:\w+ )?<CODE>\b.*\b(?:i|me|we|my|our)\b", r"\bagainst (?:my|our) <CODE>\b", r"\b(?:outside|beyond) (?:of )?what <WE><AM> (?:allowed|able|permitted)",
            r"\bnot (?:be )?(?:appropriate|possible|permitted|allowed|right) for (?:me|us)\b",
        ],
        "COURTESY": [
            r"^(?:i'?m |i am |we are |so |very )*(?:sorry|apolog\w+|my apologies|unfortunately|thanks?|thank you)\b", r"\blet me know\b", r"\bif you (?:like|want|wish|prefer|need)\b.*\b(?:i|we|me)\b",
            r"\bplease (?:consult|contact|ask|reach|speak|check with|turn to)\b", r"\b(?:perhaps|maybe) (?:a|an|some\w*|your|the)\b.*\b(?:can|could|may|might)\b", r"\b(?:happy|glad) to (?:help|explain|discuss)",
            r"\bfeel free\b", r"\bi can (?:explain|offer|describe|discuss)\b.*\binstead\b", r"\bi hope\b", r"\bi understand\b",
        ],
    },
    "de": {
        "MODAL": ["kann", "darf", "werde", "möchte", "will"],
        "NOT": ["nicht", "keine?n?"],
        "ACT": "helfen schreiben bearbeiten beantworten ausführen liefern geben tun machen erfüllen übernehmen unterstützen erledigen erstellen nachkommen aus".split(),
        "DECLINE": ["ablehnen", "verweigern", "passen", "absagen"],
        "REFUSAL": [
            r"\bich\b~60\b<NOT>\b~60\b<ACT>\b", r"\b<MODAL> ich\b~80\b<NOT>\b", r"\bich\b~12\b<MODAL>\b~60\b<NOT>\b~40\b(?:helfen|schreiben|bearbeiten|beantworten|geben|tun)\b",
            r"\bmir (?:\w+ )?(?:nicht|leider nicht) (?:möglich|erlaubt|gestattet)", r"\bnicht möglich, (?:diese|dir|ihnen|ihre|deine)\b", r"\b(?:muss|müssen) (?:ich|wir)\b~60\b<DECLINE>\b",
            r"\bich (?:muss|möchte)\b~60\b(?:ablehnen|verweigern|absagen)\b", r"\blehne ich\b~30\bab\b", r"\bgegen meine\w* (?:vorgaben|richtlinien|regeln|grundsätze|anweisungen)\b", r"\baußerhalb dessen, was mir\b",
            r"\bbin ich nicht (?:befugt|berechtigt|in der lage)\b", r"\bich bin nicht (?:befugt|berechtigt|in der lage)\b", r"\bich (?:möchte|würde)\b~40\blieber nicht\b",
        ],
        "COURTESY": [
            r"^(?:es )?tut mir leid\b", r"^entschuldig\w*", r"^(?:leider|verzeih\w*|danke)\b", r"\bgerne? (?:erkläre|helfe|beschreibe|bespreche) ich\b", r"\bstattdessen\b", r"\bich kann (?:aber|jedoch|dir|ihnen|gerne?)\b.*\b(?:erklären|beschreiben|helfen|zeigen)\b",
            r"\bsag(?:en)? (?:sie )?(?:mir |einfach )*(?:bescheid|gerne?|wenn)\b", r"\b(?:bitte )?(?:wende|frag|frage|wenden|fragen|kontaktier\w*) (?:dich|sie|dafür|am besten|bitte|eine\w*)\b",
            r"\bvielleicht (?:kann|hilft|könnte|weiß)\b", r"\bmelde dich\b", r"\bwenn du (?:magst|möchtest|willst)\b", r"\bwenn sie (?:möchten|wollen)\b",
        ],
    },
    "fr": {
        "CANNOT": ["peux", "puis", "pourrai", "saurais", "suis", "vais", "veux", "souhaite"],
        "ACT": "aider répondre fournir autorisée? en\\ mesure habilitée? faire écrire rédiger traiter discuter donner partager accéder parler aborder exécuter effectuer capable".replace("en\\ mesure", "en_mesure").split(),
        "REFUSAL": [
            r"\bje ne <CANNOT>\b~12\bpas\b~80\b<ACT>\b", r"\bje ne (?:l[ea]s? |le |vous |t')?\w+(?:rai|vais)\b~8\bpas\b", r"\bje ne (?:le |la )?ferai\b",
            r"\b(?:impossible|interdit|pas possible|pas permis|pas approprié) (?:de|pour moi de)? ?(?:vous |t'|te |d')?\w*", r"\bje préfère (?:ne pas|m'abstenir)\b",
            r"\bje (?:dois|suis obligée?|préfère|suis contrainte? )(?:de |d')?~12\b(?:refuser|décliner|passer)\b", r"\bje (?:refuse|décline)\b", r"\bà l'encontre de mes\b", r"\bcontraire à mes\b",
            r"\bsort du cadre de ce que je\b", r"\bau-delà de ce que je suis\b",
        ],
        "COURTESY": [
            r"^(?:désolée?|pardon|navrée?|je suis (?:vraiment )?désolée?|malheureusement|merci|excuse\w*|toutes mes excuses)\b", r"\bn'hésite[sz]? pas\b", r"\bje (?:peux|pourrais) (?:en revanche|plutôt|toutefois|cependant|volontiers|néanmoins)\b",
            r"\bsi (?:vous|tu) (?:voulez|veux|souhaitez|le souhaitez|préférez|préfères)\b", r"\bveuillez\b", r"\badresse[sz]?-", r"\bpeut-être\b", r"\bdis-moi\b", r"\bdites-moi\b", r"\bà la place\b", r"\bfaites-moi\b",
        ],
    },
    "es": {
        "CANNOT": ["puedo", "podré", "podría", "voy a", "quiero"],
        "ACT": "ayudar\\w* responder\\w* dar\\w* hacer\\w* escribir\\w* proporcionar\\w* atender\\w* hablar tratar\\w* cumplir\\w* realizar\\w* compartir\\w* ofrecer\\w* aceptar\\w* llevar contestar\\w* seguir continuar".split(),
        "REFUSAL": [
            r"\bno <CANNOT>\b~40\b<ACT>\b", r"\bno (?:estoy autorizad[oa]|se me permite|me (?:es|resulta) posible|me está permitido|me corresponde|me siento cómod[oa]|sería (?:adecuado|apropiado|correcto))\b",
            r"\b(?:debo|tengo que|he de|prefiero|me veo obligad[oa] a) (?:rechazar|declinar|negarme|decir que no|no)\b", r"\bme niego\b", r"\bprefiero no\b", r"\bno (?:lo|la|los|las) (?:haré|voy a|escribiré|puedo)\b", r"\ben contra de mis\b",
            r"\bfuera de lo que (?:se me|me|puedo)\b", r"\bme temo que no\b~30\bpued\w+",
        ],
        "COURTESY": [
            r"^(?:lo siento|perdón|perdona|disculpa\w*|lamentablemente|por desgracia|lo lamento|gracias|mis disculpas)\b", r"\bd[ií](?:me|game) si\b", r"\bsi (?:quieres|quiere|lo deseas|lo desea|prefieres|te parece)\b",
            r"\bpor favor,? (?:consulta|consulte|acude|acuda|habla|pregunta|contacta|dir[ií]\w+)\b", r"\bconsult[ae] (?:a|con)\b", r"\b(?:quizá|quizás|tal vez)\b", r"\ben su lugar\b", r"\bpuedo (?:en cambio|explicar|explicarte|explicarle|describir|contar)\w*",
            r"\ben cambio,? puedo\b", r"\bno dudes\b", r"\bavísame\b",
        ],
    },
}


def derived(rules: dict[str, list[str]], name: str) -> re.Pattern:
    """One expression for all texts that a nonterminal of a language derives."""

    def expand(production: str) -> str:
        out = re.sub(r"~(\d+)", r".{0,\1}", production.replace("_", " "))
        return re.sub(r"<([A-Z_ ]+)>", lambda m: "(?:" + "|".join(map(expand, rules[m[1].replace(" ", "_")])) + ")", out)

    return re.compile("|".join(map(expand, rules[name])))


REFUSAL = [derived(rules, "REFUSAL") for rules in GRAMMAR.values()]
COURTESY = [derived(rules, "COURTESY") for rules in GRAMMAR.values()]
SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’»)\]]*\s+|\n+")


# ---- parts of a verdict --------------------------------------------------------------------------


def is_empty(answer: str | None) -> bool:
    words = WORD.findall(answer or "")
    return not words or (len(words) <= 3 and " ".join(words).lower() in NOTHING and answer.strip()[-1:] not in ".!?")


_BASE = np.uint64(0x9E3779B97F4A7C15)


class _Runs:
    """Karp-Rabin hashes of all runs of a sequence of words; their marked words belong to no run."""

    def __init__(self, ids: np.ndarray, powers: np.ndarray) -> None:
        n = len(ids)
        self.ids, self.back = ids, powers[len(powers) - 1 - np.arange(n + 1)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * _MIXED * powers[:n], dtype=np.uint64)))
        self.free = np.ones(n, np.int64)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each unmarked run of ``size`` words."""
        full = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.free)))
        at = np.flatnonzero(full[size:] - full[:-size] == size)
        return at, (self.sums[at + size] - self.sums[at]) * self.back[at]


_MIXED = np.uint64(0xFF51AFD7ED558CCD)


def tiles(a: list[str], b: list[str], shortest: int = 3) -> int:
    """Words of ``a`` that greedy string tiling covers with tiles of ``b`` of at least ``shortest`` words.

    The length of the longest run still free on both sides is found by bisection over hashed runs; all tiles
    of that length are laid in one pass.  A pass costs n log n and the lengths of the tiles add up to no more
    than n, so repetitive texts don't take cubic time.  Equal hashes are compared word by word.
    """
    if min(len(a), len(b)) < shortest:
        return 0
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in (a, b))
    powers = np.cumprod(np.full(max(len(x), len(y)) + 1, _BASE), dtype=np.uint64)
    p, q = _Runs(x, powers), _Runs(y, powers)
    covered, most = 0, min(len(x), len(y))
    while True:
        low, high = shortest - 1, most
        while low < high:
            mid = (low + high + 1) // 2
            if np.isin(p.windows(mid)[1], q.windows(mid)[1]).any():
                low = mid
            else:
                high = mid - 1
        if low < shortest:
            return covered
        where: dict[int, list[int]] = {}
        at, keys = q.windows(low)
        for j, k in zip(at[::-1].tolist(), keys[::-1].tolist(), strict=True):
            where.setdefault(k, []).append(j)  # the first one last
        at, keys = p.windows(low)
        for i, k in zip(at.tolist(), keys.tolist(), strict=True):
            rest = where.get(k)
            if not rest or not (p.free[i] and p.free[i + low - 1]):
                continue
            while rest and not (q.free[rest[-1]] and q.free[rest[-1] + low - 1]):
                rest.pop()  # a tile lies there
            if rest and (x[i : i + low] == y[rest[-1] : rest[-1] + low]).all():
                p.free[i : i + low] = q.free[rest[-1] : rest[-1] + low] = 0
                covered += low
        most = low if low > shortest else low - 1
        if most == low and not np.isin(p.windows(low)[1], q.windows(low)[1]).any():
            most = low - 1


def is_copy(prompt: str | None, answer: str, least: float = 0.8) -> bool:
    a, u = WORD.findall(answer.lower()), WORD.findall((prompt or "").lower())
    if len(a) < 4:
        return bool(a) and a == u
    if not 0.6 * len(u) <= len(a) <= 1.4 * len(u):
        return False
    sa, su = set(a), set(u)
    if len(sa & su) < 0.7 * len(sa):
        return False
    n = tiles(a, u)
    return n >= least * len(a) and n >= 0.7 * len(u)


def is_refusal(answer: str) -> bool:
    """Whether the answer's prose has refusals and, but for courtesies, nothing else; code says nothing here."""
    if TICKS.search(answer):
        return False  # whoever gives a block of code doesn't only decline
    refused = False
    for s in SENTENCE.split(SPAN.sub(" it ", answer).replace("’", "'").lower().strip()):
        s = s.strip()
        if not WORD.search(s):
            continue
        if any(p.search(s) for p in REFUSAL):
            refused = True
        elif not any(p.search(s) for p in COURTESY):
            return False
    return refused


def prose(text: str) -> str:
    """``text`` without fenced code, code spans and quoted lines."""
    parts = TICKS.split(text)
    text = "\n".join(parts[::4])
    text = SPAN.sub(" ", text)
    return "\n".join(x for x in text.split("\n") if not x.lstrip().startswith(">"))


#: Letters that are not Latin.
FOREIGN = re.compile("[^\x00-ɏ]+")


def script(letters: str) -> str:
    """The script of most letters, as the first word of their names; kana make a text Japanese."""
    count = Counter(unicodedata.name(c, "?").split()[0] for c in letters)
    if count["HIRAGANA"] + count["KATAKANA"] > 0:
        return "HIRAGANA"
    return max(count, key=lambda k: (count[k], k))


def language(text: str, least: float) -> str | None:
    """The language of a text by script and function words; null where they don't say."""
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    if not words:
        return None
    letters = "".join(words)
    foreign = "" if letters.isascii() else "".join(FOREIGN.findall(letters))
    if len(foreign) > 0.6 * len(letters) and len(letters) >= 4 * least:
        return script(foreign)
    score = dict.fromkeys(FUNCTION, 0.0)
    for w in words:
        for lang, x in WEIGHTS.get(w, {}).items():
            score[lang] += x
    (first, lang), (second, _) = sorted(((x, k) for k, x in score.items()), reverse=True)[:2]
    return lang if first >= least and first >= 1.5 * second + 0.5 else None


def is_other_language(prompt: str | None, answer: str) -> bool:
    if not prompt:
        return False
    theirs = language(prose(answer), 2.6)
    if theirs is None:
        return False
    ours = language(prose(prompt), 2.6)
    return ours is not None and ours != theirs and not LANGUAGES.search(prompt)


class Ends:
    """What the corpus says about the ends of list items."""

    def __init__(self, within: dict[str, int], last: dict[str, int], total: int = 0) -> None:
        self.within, self.last = within, last
        self.known, self.common = max(KNOWN_LEAST, KNOWN * total), max(COMMON_LEAST, COMMON * total)
        self.starts = {w[:k] for w, n in within.items() if n >= self.known for k in range(1, len(w))}

    def incomplete(self, word: str) -> bool:
        n = self.within.get(word, 0)
        if n >= self.common:
            return self.last.get(word, 0) * 50 < n
        return n < self.known and word in self.starts


# Brackets and quotation marks, and elements of markup that need an end tag.
CLOSES = {"(": ")", "[": "]", "{": "}", "«": "»", "»": "«", "“": "”", "„": "“”", '"': '"'}
ELEMENTS = frozenset(
    "a abbr article aside audio b blockquote button caption code details div dl em fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header i iframe kbd label main mark nav ol pre q s script section select small span strong style sub summary sup svg table textarea title u ul video".split()
)
FINAL = frozenset(".!?…。！？:;)]}»”\"'’*_~|>`")
FENCE = re.compile(r"(`{3,}|~{3,})([^\n]*)$", re.MULTILINE)
SYMBOL = re.compile(
    r"(?P<blank>\n[ \t]*\n)|(?P<face>[:;=][-']?[()\[\]])|(?P<interval>[\[(]\s*-?[\w.∞]+\s*,\s*[-+]?[\w.∞]+\s*[\])])|(?P<ticks>`+)|(?P<tag></?([A-Za-z][\w:-]*)(?:\s[^<>]*)?>)|(?P<torn><[A-Za-z/!][^<>\s]*(?:\s+[\w:-]+=[^<>]*)?\Z)|(?P<mark>[()\[\]{}«»“”„\"])"
)

SOME = re.compile(r"[:;=(\[`<)\]{}«»“”„\"]|\n(?=[ \t]*\n)")


def prose_parts(text: str) -> tuple[list[str], bool]:
    """The stretches outside fenced code, and whether a fence is still open at the end.

    A fence may begin behind other text of its line; it ends with marks at the start of a line, whatever follows
    behind a blank.
    """
    parts, at = [], 0
    while True:
        begin = FENCE.search(text, at)
        while begin and begin[1] in begin[2]:
            begin = FENCE.search(text, begin.end())  # a code span
        if begin is None:
            return [*parts, text[at:]], False
        parts.append(text[at : begin.start()])
        end = re.compile(rf"^[ \t>]*{begin[1][0]}{{{len(begin[1])},}}(?=\s|\Z)", re.MULTILINE).search(text, begin.end())
        if end is None:
            return parts, True
        at = end.end()


def left_open(text: str) -> list[str]:
    """Pushdown parser over a stretch without fences: what is still on the stack at its end.

    A closer takes everything down to its opener off the stack, and is ignored if it has none; a code span or a
    straight quotation ends with its paragraph.  Tags count where the text is markup: it begins with a
    tag or has an end tag, and the element needs one.
    """
    if "``" not in text:
        text = SPAN.sub(" ", text)  # code spans of one mark on one line, the usual ones
    stack: list[str] = []
    closed = set(re.findall(r"</([A-Za-z][\w:-]*)\s*>", text)) if "</" in text else set()
    markup = bool(closed) or text.lstrip().startswith("<")
    at = 0
    while place := SOME.search(text, at):
        at = place.end()
        m = SYMBOL.match(text, place.start())
        if m is None:
            continue
        at = m.end()
        kind, s = m.lastgroup, m.group()
        if kind == "blank":
            stack = [x for x in stack if x not in ('"', "`")]
        elif kind == "face":
            if s[-1] in ")]" and CLOSES.get(stack[-1] if stack else "") == s[-1]:
                stack.pop()  # a bracket behind a colon, after all
        elif kind == "ticks":
            end = re.compile(rf"(?<!`){s}(?!`)").search(text, at)
            gap = text.find("\n\n", at)
            if end and (gap < 0 or end.start() < gap):
                at = end.end()
            else:
                stack.append("`")
        elif kind == "torn":
            stack.append(s)
        elif kind == "mark" or kind is None:
            c = s
            if c == '"':
                before, after = text[m.start() - 1 : m.start()], text[at : at + 1]
                if '"' in stack:
                    del stack[len(stack) - 1 - stack[::-1].index('"') :]
                elif (not before or before.isspace() or before in "([{>=:,–—*_") and after and not after.isspace():
                    stack.append(c)
                continue
            k = next((i for i in range(len(stack) - 1, -1, -1) if c in CLOSES.get(stack[i], "")), None)
            if k is not None and not (c == "“" and stack[k] != "„"):
                del stack[k:]
            elif c in "([{«„“" or (c == "»" and text[at : at + 1].strip() and not text[m.start() - 1 : m.start()].strip()):
                stack.append(c)
        elif markup:  # a tag
            name = re.match(r"</?([A-Za-z][\w:-]*)", s)[1]
            if s.startswith("</"):
                if f"<{name.lower()}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name.lower()}>") :]
            elif not s.endswith("/>") and (name.lower() in ELEMENTS or name in closed):
                stack.append(f"<{name.lower()}>")
    return stack


def is_truncated(answer: str, ends: Ends) -> bool:
    text = answer.rstrip().rstrip("​")
    if MARKER.search(text):
        return True
    parts, opened = prose_parts(text)
    if opened:
        return True
    if left_open("\n\n".join(p.strip("\n") if len(parts) > 1 else p for p in parts)):
        return True
    if not parts[-1].strip():  # ends with a whole block of code
        return False
    line = text.rsplit("\n", 1)[-1]
    last = text[-1]
    if re.match(r"^#{1,6}\s", line) or re.fullmatch(r"\s*(?:[-*+•]|\d+[.)])", line):
        return True
    if line.startswith("|") and last != "|" and re.search(r"(?m)^\|.*\|\s*$", text):
        return True
    if last == ":" or last in ",-–—([{«„&+=/\\":
        return True
    if last in FINAL or not (last.isalnum() or last == "_"):
        return False
    item = ITEM.match(line)
    if item:
        words = re.findall(r"[^\W\d_]+", item.group(1).lower())
        return bool(words) and ends.incomplete(words[-1])
    words = text.split()
    if len(words) <= 2:
        return False
    if line.lstrip().startswith((">", "|")) or re.match(r"^\S+\s*[:=]\s*\S+$", line):
        return False
    return True


def verdict(prompt: str | None, answer: str | None, ends: Ends) -> str | None:
    """The defect of a pair, or null."""
    if is_empty(answer):
        return "empty"
    if is_copy(prompt, answer):
        return "copied"
    if is_refusal(answer):
        return "refusal"
    if is_other_language(prompt, answer):
        return "other_language"
    return "truncated" if is_truncated(answer, ends) else None


# ---- over a table ---------------------------------------------------------------------------------


def learn_ends(exchanges: DataFrame) -> tuple[dict[str, int], dict[str, int], int]:
    """Counts of words within list items, of those that end an item which another one follows, and of all words.

    All rows count; a task sends its sums whenever it holds 200,000 words, and only words above the share
    ``KNOWN`` come to the driver.
    """
    most = 200_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        within: Counter = Counter()
        last: Counter = Counter()

        def flush() -> pa.RecordBatch:
            batch = pa.record_batch([pa.array(list(within)), pa.array(list(within.values()), pa.int64()), pa.array([last[w] for w in within], pa.int64())], names=["word", "n", "k"])
            within.clear()
            last.clear()
            return batch

        for b in batches:
            for t in b.column(0).to_pylist():
                items = [m.group(1) for m in map(ITEM.match, (t or "").split("\n")) if m]
                for x in items[:-1]:
                    w = re.findall(r"[^\W\d_]+", SPAN.sub(" ", x).lower())
                    within.update(w)
                    if w and x.rstrip()[-1:].isalpha():
                        last[w[-1]] += 1
            if len(within) >= most:
                yield flush()
        if within:
            yield flush()

    words = cut(exchanges.select("assistant_message").mapInArrow(count, "word string, n bigint, k bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = words.agg(F.sum("n")).first()[0] or 0
    got = words.where(F.col("n") >= max(KNOWN_LEAST, KNOWN * total)).collect()  # at most 1 / KNOWN words
    return {r[0]: r[1] for r in got}, {r[0]: r[2] for r in got}, total


def defective(exchanges: DataFrame) -> DataFrame:
    """id and defect of each defective pair."""
    sent = exchanges.sparkSession.sparkContext.broadcast(learn_ends(exchanges))

    def make() -> Callable[..., Iterable[tuple]]:
        ends = Ends(*sent.value)

        def each(rid: int, prompt: str | None, answer: str | None) -> Iterable[tuple]:
            d = verdict(prompt, answer, ends)
            return [(rid, d)] if d else ()

        return each

    return map_rows(exchanges.select(F.col("id").cast("long"), "user_message", "assistant_message"), make, "id bigint, defect string")
