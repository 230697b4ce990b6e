"""Generated, labelled sentences for the trees that find personal data, and the file that holds the fitted trees.

Sentences of everyday life in four languages (post, shops, schools, clubs, travel, offices) hold personal data in many
notations, with and without words that announce it, and things that only look like it.  All names, numbers and
domains are made up by a seeded generator.  None of the sentences comes from the tables that the operator is run on.
A candidate span is a positive case if it covers most of a labelled span of its kind, and little else.

``python -m braidlog.llm.personal_training`` fits the trees again and writes the file.
"""

from __future__ import annotations

import json
import os
import random
from collections.abc import Callable
from functools import cache

import numpy as np

from braidlog.llm.boosting import Trees
from braidlog.llm.personal import GIVEN, TREES, candidates

CASES, SEED = 24_000, 7
FILE = os.path.join(os.path.dirname(os.path.abspath(__file__)), TREES)
GIVEN_ORDER = sorted(GIVEN)
MIX = "bra len tor mi ga vel ster ham wick rin do sal mon ker bel far tin lu os ar den gre pol zan".split()
THINGS = "Garden Party Summer Market Winter Sale Town Hall Main Station Blue Whale Golden Gate Red Dragon Silver Spoon Open Day Book Club Free Entry Grand Piano Central Library Board Game Night Train Square Dance Apple Pie Royal Mail First Aid Second Floor Green Tea Data Centre Cloud Kitchen Print Shop Power Station Front Desk Night Shift Lost Property".split()
NOUNS_DE = "Rechnung Garten Bahnhof Lieferung Schule Verein Wagen Küche Kasse Reise Woche Schlüssel Tasche Karte Brücke Zeitung Fenster Sommer Kuchen Antrag".split()
PLACES = ["New Delhi", "San Marino", "Los Cabos", "Rio Negro", "Bad Tölz", "Cape Town", "Hong Kong", "South Dakota", "Santa Cruz", "Le Havre", "Las Palmas", "West Virginia", "Great Britain", "Sierra Nevada"]
HANGUL, HAN = "김이박최정강조윤장임", "田中山本佐藤木村林王李"
SYLLABLES = "민수지영현우서준하은도윤예진"
CYRILLIC = "ва ро ни ле дан ко ми ар тол сер пет лин га".split()
FILL = {
    "en": ["The bakery opens at eight.", "We meet again next week.", "Bring warm clothes, please.", "Nobody answered the door.", "It rained all day."],
    "de": ["Die Bäckerei öffnet um acht.", "Wir sehen uns nächste Woche.", "Das Paket kam nie an.", "Es hat den ganzen Tag geregnet."],
    "fr": ["La boulangerie ouvre à huit heures.", "On se revoit la semaine prochaine.", "Le colis n’est jamais arrivé.", "Il a plu toute la journée."],
    "es": ["La panadería abre a las ocho.", "Nos vemos la semana próxima.", "El paquete nunca llegó.", "Llovió todo el día."],
}


class Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def pick(self, xs):
        return self.r.choice(xs)

    def n(self, digits: int, first: str = "123456789") -> str:
        return self.pick(first) + "".join(self.pick("0123456789") for _ in range(digits - 1))

    def word(self, parts: int = 2) -> str:
        return "".join(self.pick(MIX) for _ in range(parts))

    def family(self) -> str:
        f = self.word(self.pick([2, 2, 3])).capitalize()
        return f"{f}-{self.word().capitalize()}" if self.r.random() < 0.08 else f

    def given(self) -> str:
        return (self.pick(GIVEN_ORDER) if self.r.random() < 0.75 else self.word()).capitalize()

    def accented(self, name: str) -> str:
        """Some letters of some names with accents."""
        if self.r.random() < 0.6:
            return name
        swap = {"a": "á", "e": "é", "i": "í", "o": "ö", "u": "ü", "n": "ñ", "c": "ç"}
        return "".join(swap[c] if c in swap and self.r.random() < 0.25 else c for c in name)

    # each maker gives the span's text

    def foreign(self) -> str:
        """A name in Cyrillic letters."""
        make = lambda: "".join(self.pick(CYRILLIC) for _ in range(self.pick([2, 3]))).capitalize()
        return f"{make()} {make()}"

    def titled(self) -> tuple[str, str]:
        """A Hangul or Han name and the title behind it."""
        if self.r.random() < 0.5:
            return self.pick(HANGUL) + "".join(self.pick(SYLLABLES) for _ in range(2)), self.pick([" 씨", "님", " 선생님", " 과장님"])
        return "".join(self.pick(HAN) for _ in range(self.pick([2, 3]))), self.pick(["さん", "様", "先生"])

    def person(self) -> str:
        if self.r.random() < 0.04:
            return self.foreign()
        g, f = self.accented(self.given()), self.accented(self.family())
        return self.pick([f"{g} {f}"] * 6 + [f"{g} {self.pick('ABEJKMRST')}. {f}", f"{f}, {g}", f"{f} {g}", f"{g} {f.upper()}", f"{f.upper()} {g}", f"{g} de la {f}", f"{f.upper()}, {g}"])

    def email(self) -> str:
        g, f = self.given().lower(), self.word()
        if self.r.random() < 0.06:  # short ones
            letter = lambda: self.pick("abcdefghijklmnopqrstuvwxyz")
            return f"{self.pick([letter(), letter() + letter(), f])}@{letter()}{self.pick(['', letter()])}.{self.pick(['co', 'de', 'io', 'fr', 'es', 'com'])}"
        local = self.pick([f"{g}.{f}", f"{g[0]}{f}", f"{f}_{g}", f"{g}{self.n(2)}", f, f"{g[0]}-{f}", f"{g}.{f}+ci"])
        labels = [self.word(), *self.pick([["com"], ["example", "org"], ["example"], ["test"], ["net"], ["co", "uk"], ["invalid"], ["de"]])]
        at, dot = self.pick([("@", ".")] * 6 + [(" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("[at]", "[dot]"), (" arroba ", " punto "), (" arobase ", " point "), (" (at) ", "."), (" @ ", "."), (" {at} ", " {dot} ")])
        if at == " @ ":
            at = "@"
        if dot not in (".",) and "." in local and self.r.random() < 0.3:
            local = local.replace(".", dot)
            local = local.replace(dot, ".")
        s = local + at + dot.join(labels)
        s = s.upper() if self.r.random() < 0.06 and "[" not in s else s
        return "mailto:" + s if self.r.random() < 0.08 else s

    def phone(self) -> str:
        a, b, c = self.n(3, "23456789"), self.n(3), self.n(4, "0123456789")
        p = [self.n(2, "0123456789") for _ in range(4)]
        s = self.pick([
            f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 {a} {b} {c}", f"+1{a}{b}{c}", f"{a} {b} {c}", f"+1-{a}-{b}-{c}", f"07{self.n(3)} {self.n(6)}", f"+44 7{self.n(3)} {self.n(6)}", f"020 {self.n(4)} {c}", f"+44 20 {self.n(4)} {c}",
            f"030 {self.n(5)} {b}", f"030/{self.n(8)}", f"(030) {self.n(5)}-{b}", f"+49 30 {self.n(8)}", f"0049 30 {self.n(5)} {b}", f"0{self.n(3)} {self.n(6)}", f"+49 (0)30 {self.n(7)}",
            f"0{self.pick('1234569')} {' '.join(p)}", f"0{self.pick('1234569')}.{'.'.join(p)}", f"0{self.pick('1234569')}{''.join(p)}", f"+33 {self.pick('1234569')} {' '.join(p)}", f"+33 (0){self.pick('1234569')} {' '.join(p)}",
            f"9{self.n(2)} {' '.join(p[:3])}", f"9{self.n(2)}-{'-'.join(p[:3])}", f"6{self.n(2)} {b} {self.n(3)}", f"+34 9{self.n(2)} {' '.join(p[:3])}", f"+349{self.n(8)}", f"6{self.n(8)}", f"9{self.n(2)}{''.join(p[:3])}",
        ])
        return f"{s} ext. {self.n(2)}" if self.r.random() < 0.05 else s

    def id_digits(self) -> str:
        x = self.pick(["000", "666", "9" + self.n(2), self.n(3)])
        a, b = self.n(2, "0123456789"), self.n(4, "0123456789")
        s, y, m, d, c, o, k = self.pick("12"), self.n(2), self.n(2, "0123456789"), self.n(2), self.n(3), self.n(3, "0123456789"), self.n(2, "0123456789")
        if self.r.random() < 0.1:
            return self.pick([f"{self.n(3)}.{self.n(3)}.{self.n(3)}-{self.n(2)}", f"{self.n(4)} {self.n(4)} {self.n(4)}"])
        return self.pick([f"{x}-{a}-{b}"] * 3 + [f"{x} {a} {b}"] * 2 + [f"{x}{a}{b}"] * 2 + [f"{s} {y} {m} {d} {c} {o} {k}", f"{s}{y}{m}{d}{c}{o}{k}", f"{self.n(2)} {self.n(3)} {self.n(3)} {self.n(3)}", self.n(11)])

    def id_lettered(self) -> str:
        n = self.n(8, "0123456789")
        dni = n + self.pick(["", " ", "-"]) + ("TRWAGMYFPDXBNJZSQVHLCKE"[int(n) % 23] if self.r.random() < 0.7 else self.pick("ABCDEFGHJKLMNPQRSTVWXYZ"))
        nie = self.pick("XYZ") + self.pick(["", "-"]) + self.n(7) + self.pick(["", "-"]) + self.pick("ABCDEFGHJ")
        return self.pick([dni] * 4 + [nie, f"T{self.n(8)}", f"L{self.pick('ZXYWJ')}{self.pick('GHJK')}{self.pick(['', ' '])}{self.n(6)}", f"A{self.pick('BEH')} {self.n(2)} {self.n(2)} {self.n(2)} {self.pick('ABCD')}", f"C01{self.n(6)}", f"X{self.n(8)}", f"{''.join(self.pick('BCDFGLMNPRSTV') for _ in range(6))}{self.n(2)}{self.pick('ABCDEHLMPRST')}{self.n(2)}{self.pick('ABCDEFGHIL')}{self.n(3)}{self.pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ')}"])

    def address(self, lang: str) -> str:
        f = lambda: self.word().capitalize()
        if lang == "en":
            s = f"{self.n(self.pick([2, 2, 3]))} {f()} {self.pick('Street St Lane Road Rd Ave Avenue Drive Court Way Place Blvd'.split())}"
            s += self.pick(["", "", f", Apt {self.n(1)}", ", Unit B", f", Suite {self.n(3)}"])
            return s + self.pick(["", f", {f()}", f", {f()}, ZZ {self.n(5)}", f", {f()} {self.n(5)}"])
        if lang == "de":
            s = f"{f()}{self.pick(['straße', 'weg', 'gasse', 'platz', 'allee', 'str.', 'ring', 'damm', 'straat', 'laan'])} {self.n(self.pick([1, 2, 3]))}{self.pick(['', '', 'a', ' b'])}"
            if self.r.random() < 0.12:
                s = f"{self.pick(['Am', 'An der', 'Im', 'Zum', 'Unter den'])} {f()} {self.n(self.pick([1, 2]))}"
            return s + self.pick(["", f", {self.n(5, '0123456789')} {f()}"])
        if lang == "fr":
            s = f"{self.n(2)}{self.pick(['', '', ' bis', ' ter'])}{self.pick(['', ','])} {self.pick('rue avenue boulevard impasse place chemin quai allée'.split())} {self.pick(['de la', 'des', 'du', 'aux', 'de'])} {f()}{self.pick(['', 's'])}"
            return s + self.pick(["", f", {self.n(5)} {f()}", f", {self.n(5)} Saint-{f()}"])
        s = f"{self.pick(['Calle', 'Avenida', 'Plaza', 'Paseo', 'calle', 'C/', 'Calle', 'Avenida', 'Via', 'Viale', 'Piazza', 'Rua'])} {self.pick(['de la ', 'de los ', 'del ', ''])}{f()}{self.pick([' ', ', ', ' n.º '])}{self.n(self.pick([2, 3]))}"
        return s + self.pick(["", "", ", 3.º B", ", 1.º izq."]) + self.pick(["", f", {self.n(5)} {f()}"])

    def nothing(self) -> str:
        """Things that only look like personal data."""
        n, w, t = self.n, self.word, lambda: self.pick(THINGS)
        g = self.given()
        return self.pick([
            f"Install {w()}@{n(1)}.{n(2)}.{n(1)} first.", f"Use the decorator `@{w()}({n(1)})` there.", f"remote git@{w()}.org:{w()}/{w()}.git", f"add @{w()}/{w()}@{n(1)}.{n(1)}.0", f"https://{w()}@{w()}.example/{w()}", f"kits@{n(2)} pieces, rods@{n(1)}.{n(2)} each", f"see {w()}@{n(2)} and {w()}@{n(1)}.x", f"open ssh://{w()}@{w()}.net:{n(4)}/x", f"`{w()}@{n(1)}.{n(1)}.{n(2)}`, then wait",
            f"The parcel number is {n(12)}.", f"Meter reading {n(4)}-{n(4)}-{n(3)}, as before.", f"Printed 20{n(2, '12')}-0{n(1)}-1{n(1)}, edition {n(5)}.", f"Printer {n(3, '1')}.0.2.{n(2)} is {n(2)}.{n(1)} metres away.", f"Voucher {w(1).upper()}-{n(4)} has expired.", f"Bus XYZ-{n(7)} is late.", f"crc {n(10)}, md5 {n(8)}", f"checksum={n(12)}", f"build {n(8)} failed",
            f"Reference {n(8)}{w(1)}{n(4)}, shelf {n(2)}.", f"Look at `maps/street_{n(2)}.pdf`, page {n(2)}.", "Leave the fields `tax_id` and `mobile` empty.", "the table has columns name, phone, ssn and email", f"at position {n(8)} of {n(9)}", f"time={n(13)} count={n(9)}", f"since epoch {n(10)}", f"invoice no {n(9)}, order {n(10)}", f"rows {n(7)} to {n(7)}", f"run {n(9)} took {n(3)} ms", f"batch {n(8)}, lot {n(7)}",
            f"ISBN 978-{n(1)}-{n(4)}-{n(4)}-{n(1)}", f"on 20{n(2, '12')}-1{n(1, '012')}-2{n(1)} at 12:30", f"{n(2, '12')}.{n(2, '1')}.20{n(2, '12')} gegen acht", f"id={n(8)} seq={n(7)}", f"Screw {self.pick(['QRS', 'ABD', 'EIO'])}{n(6)} is sold out.", f"Seat {n(8)}{self.pick('ABC')} is free.", f"0{n(3)} {n(4)} {n(4)} {n(4)} on the card", f"ticket {n(7)} and version {n(2)}.{n(3)}.{n(4)}",
            f"{t()} {t()} and {t()} {t()} share one hall.", f"We visit the {t()} {t()} today.", f"our flat in {self.pick(PLACES)} is cold", f"{self.pick(PLACES)} is far away.", f"the {t()} {t()} said so", f"{g} {self.pick(['Street', 'Island', 'Cup', 'Hall', 'Festival', 'Prize', 'Bridge', 'Museum'])} is near.", f"{t()} {t()} opens soon.", f"Is {t()} {t()} still on, {t()} {t()} asked.", f"{t()} {t()} ({n(2)}) and {t()} {t()}, as ever", f"with {t()} {t()} from {t()} {t()}",
            f"Heute kauft {self.pick(NOUNS_DE)} {self.pick(NOUNS_DE)} niemand.", f"Im {self.pick(NOUNS_DE)} {n(3)} fehlt etwas.", f"Am Ende {n(2)} Gäste.", f"Zum Kapitel {n(1)} gehört mehr.", f"Mit {self.pick(NOUNS_DE)} {self.pick(NOUNS_DE)}.", f"Die {self.pick(NOUNS_DE)} kostet viel.", f"Der {self.pick(NOUNS_DE)} war zu.", f"Danach {self.pick(NOUNS_DE)} und {self.pick(NOUNS_DE)}.", f"Beim {self.pick(NOUNS_DE)} half er.",
            f"In 20{n(2, '12')} Dutch Street changed.", f"line {n(2)} Hill Valley", f"cette place {n(2)} est prise", f"Route {n(2)} is closed.", f"la ronda {n(2)} del torneo", f"step {n(1)} Way out", f"they sat at {w()} dot", f"we stopped at {w()} point", f"The Old {t()} is shut.", f"Dear {t()} {t()}, hello", f"Ask {t()} about it.", f"Before {t()} comes {t()}.", f"On {self.pick(['Monday', 'Friday'])} {self.pick(['March', 'April', 'June'])} begins.",
            f"from {n(4)}-{n(5)} onwards", f"the value {n(9)} is too large", f"{n(16)} grains", f"a total of {n(11)}", f"0x{n(8)} or {n(3)}.{n(3)}.{n(3)}", f"{n(3)}.{n(3)}.{n(1)}.{n(3)} is a code", f"server {n(3)}.{n(2)}.{n(3)}.{n(2)} is down", f"{n(2)}.{n(3)}.{n(2)}.{n(3)}", f"score {n(3)}-{n(2)}-{n(4)}" if self.r.random() < 0.2 else f"pages {n(3)}-{n(3)}", f"## {t()} {t()}", f"- {t()} {t()}", f"* {t()} {t()} {t()}", f"{self.foreign().split()[0]} это слово.",
        ])


# Sentences with a place for the span, by kind and language.
FRAMES: dict[str, dict[str, list[str]]] = {
    "person": {
        "en": ["My neighbour {} waters the plants.", "Please ask {} about the keys.", "cc: {}", "Author: {} <me@example.org>", "Approved-by: {}", "Many thanks, {}", "According to {}, lunch is late.", "{} said the bus was full.", "The prize was given to {}.", "# owner: {}", "At dinner {} sang a song.", '{{"customer": "{}", "age": 40}}', "| {} | blue |", "--\n{}\n", "{} left early.", "We saw {} at the pool.", "Dear {}, welcome.", "guest {} arrived", "The cake that {} baked is gone.", "{}", "A letter from {} came today.", "I met {} on the train.", "Was {} at school?", "Signed, {}", "name={} room=12", "Then {} and a friend went home.", "{} and {} danced.", "{}, {} and the coach won.", "Hi {}!", "Contact {} for tickets.", "{} (left) smiles.", "Reviewer: {}", "the dog of {} barks", "- {} brings bread", "Call {} before six."],
        "de": ["Meine Nachbarin {} gießt die Blumen.", "Frag doch {} nach dem Schlüssel.", "Laut {} fällt das Essen aus.", "{} sagt, der Bus war voll.", "Liebe Grüße, {}", "Autor: {}", "Gestern hat {} gesungen.", "Frau {} ist krank.", "Den Kuchen brachte {}.", "{}", "Hallo {}, willkommen.", "Ein Brief von {} kam an.", "{} und {} tanzten.", "Wir trafen {} am See.", "Zuständig: {}", "Mit {} fuhr ich heim."],
        "fr": ["Ma voisine {} arrose les plantes.", "Demande les clés à {}.", "auteur : {}", "{} dit que le bus était plein.", "Selon {}, on mange tard.", "Bien à vous, {}", "Hier {} a chanté.", "Bonjour {}, bienvenue.", "{}", "Une lettre de {} est arrivée.", "{} et {} ont dansé.", "Madame {} est malade.", "Nous avons vu {} au marché.", "Le gâteau vient de {}."],
        "es": ["Mi vecina {} riega las plantas.", "Pregunta a {} por las llaves.", "autor: {}", "{} dice que el autobús iba lleno.", "Según {}, comemos tarde.", "Un abrazo, {}", "Anoche {} cantó.", "Hola {}, bienvenida.", "{}", "Llegó una carta de {}.", "{} y {} bailaron.", "La señora {} está enferma.", "Vimos a {} en la plaza.", "El pastel lo trajo {}."],
    },
    "email": {"en": ["Send the photos to {} tonight.", "Host <{}>", "order confirmed for {} just now.", "customer_mail={} n=3", "Does {} still work?", "The bill went to {} twice.", "| x | {} |", "{}", "Contact: {}", "My address ({}) is new.", "mail {}, not the other", "Escribe a {} hoy.", "Schreib an {} bitte.", "Envoyez à {} svp.", '"email": "{}"']},
    "phone": {
        "en": ["Ring me on {} tomorrow.", "My cell, {}, was off.", "telephone: {}", "fax {} for orders", "Text {} after school.", "whatsapp {} is best.", "The emergency number is {}.", "contact_phone={}", '"phone": "{}"', "--\nC D\n{}", "{}", "| y | {} |", "| y | e@f.org | {} |", "He wrote {} on the wall.", "Dial {} for the desk.", "reach us at {}", "mobile {}"],
        "de": ["Ruf unter {} zurück.", "Telefon {}", "Die Praxis hat die Nummer {}.", "Handy: {}", "{}", "Du erreichst mich unter {}.", "Fax {}"],
        "fr": ["Rappelez au {} demain.", "téléphone : {}", "Le numéro du cabinet est le {}.", "{}", "On me joint au {}."],
        "es": ["Llama al {} mañana.", "teléfono: {}", "El número de la clínica es {}.", "{}", "Mi móvil es {}."],
    },
    "id": {
        "en": ["social security no: {}", "SSN {} on the form", "ssn={}", "identity card {} was lost.", "The form shows the tax id {} twice.", "My social security number is {}.", "He wrote {} as his SSN.", "| Ann Poe | g@h.org | {} |", "| c | d [at] e [dot] org | {} |", "passport {} is valid", "national insurance number {}", "national id {}"],
        "de": ["| Ann Poe | g@h.org | {} |", "Ausweis Nr. {}", "Steuer-ID: {}", "die Ausweisnummer {} stimmt", "Sozialversicherungsnummer {}", "Reisepass {}", "Identifikationsnummer: {}"],
        "fr": ["| Ann Poe | g@h.org | {} |", "numéro de sécurité sociale : {}", "NIR {}", "carte d’identité n° {}", "numéro fiscal : {}", "passeport {}"],
        "es": ["| Ann Poe | g@h.org | {} |", "CPF {}", "codice fiscale {}", "DNI: {}", "mi documento de identidad es {}", "NIE: {}", "seguridad social {}", "pasaporte {}"],
    },
    "address": {
        "en": ["We live at {}, come by.", "Deliver the sofa to {}.", "The shop moved to {} in May.", "The receipt names {}.", "address: {}", 'shipping_address = "{}"', "--\nC D\n{}\n", "{}", "They found a cat near {}.", "Our new home is {}."],
        "de": ["Wir wohnen in der {}.", "Liefern Sie bitte an: {}.", "Die Quittung nennt {}.", "--\nC D\n{}\n", "{}", "Der Laden ist jetzt in {}.", "Adresse: {}"],
        "fr": ["Nous habitons {}.", "Livrez le canapé au {}.", "Le reçu indique {}.", "--\nC D\n{}\n", "{}", "adresse : {}"],
        "es": ["Vivimos en {}.", "Entrega el sofá en {}.", "El recibo dice {}.", "--\nC D\n{}\n", "{}", "dirección: {}"],
    },
}


#: Personal data that stands in some frames itself.
FIXED = {"me@example.org": "email", "e@f.org": "email", "g@h.org": "email", "d [at] e [dot] org": "email", "Ann Poe": "person"}


def sentence(m: Maker) -> tuple[str, list[tuple[int, int, str]]]:
    """A text and its labelled spans."""
    lang = m.pick(["en", "en", "de", "fr", "es"])
    fill = m.pick(FILL[lang])
    spans: list[tuple[int, int, str]] = []
    if m.r.random() < 0.02:
        name, title = m.titled()
        head = m.pick(["", "오늘 ", "昨日、", "연락처: ", "from "])
        body = f"{head}{name}{title} {m.pick(['답했다.', 'に聞く。', 'said yes.', '…'])}"
        spans.append((len(head), len(head) + len(name), "person"))
    elif m.r.random() < 0.42:
        body = m.nothing()
    else:
        kind = m.pick(["person", "person", "email", "phone", "phone", "id", "address"])
        make: Callable[[], str] = {"person": m.person, "email": m.email, "phone": m.phone, "id": lambda: m.pick([m.id_digits, m.id_lettered])(), "address": lambda: m.address(lang)}[kind]
        frames = FRAMES[kind].get(lang) or FRAMES[kind]["en"]
        head, *rest = m.pick(frames).replace("{{", "\0").replace("}}", "\1").split("{}")
        body = head
        for part in rest:
            value = make()
            if kind == "person" and rest[0] == "" and m.r.random() < 0.03:
                value = value.lower()
            spans.append((len(body), len(body) + len(value), "id_number" if kind == "id" else kind))
            body += value + part
        body = body.replace("\0", "{").replace("\1", "}")
        spans += [(body.index(x), body.index(x) + len(x), k) for x, k in FIXED.items() if x in body]
    glue = m.pick([" ", "\n"])
    if m.r.random() < 0.5:
        shift = len(fill) + 1
        return f"{fill}{glue}{body}", [(a + shift, b + shift, k) for a, b, k in spans]
    return f"{body}{glue}{fill}", spans


def is_hit(a: int, b: int, kind: str, spans: list[tuple[int, int, str]]) -> bool:
    """Whether a candidate covers most of a labelled span and little else; of names it may leave out or add a mark only."""
    least = 0.9 if kind == "person" else 0.6
    return any(k == kind and min(b, y) - max(a, x) >= least * max(b - a, y - x) for x, y, k in spans)


def cases(count: int, seed: int, make: Callable[[Maker], tuple[str, list[tuple[int, int, str]]]] = sentence) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features and labels of all candidates in ``count`` sentences, by ensemble."""
    m = Maker(seed)
    got: dict[str, tuple[list, list]] = {}
    for _ in range(count):
        text, spans = make(m)
        for a, b, kind, f, name in candidates(text):
            xs, ys = got.setdefault(name, ([], []))
            xs.append(f)
            ys.append(int(is_hit(a, b, kind, spans)))
    return {k: (np.array(x), np.array(y)) for k, (x, y) in got.items()}


def train(count: int = CASES, seed: int = SEED) -> dict[str, Trees]:
    """An ensemble for each kind of candidate; a quarter of the sentences sets the thresholds."""
    fit, held = cases(count * 3 // 4, seed), cases(count // 4, seed + 1)
    return {k: Trees().fit(*fit[k]).calibrate(*held[k]) for k in fit}


@cache
def load() -> dict[str, Trees]:
    """The fitted trees of the file."""
    with open(FILE, encoding="utf-8") as f:
        return {k: Trees.restored(v) for k, v in json.load(f).items()}


def save(trees: dict[str, Trees]) -> None:
    with open(FILE, "w", encoding="utf-8") as f:
        json.dump({k: t.stored() for k, t in sorted(trees.items())}, f, separators=(",", ":"))
        f.write("\n")


if __name__ == "__main__":
    save(train())
