"""A small labelled table: invented sentences, and sentence forms filled by rule. <kind words> marks personal data."""

from __future__ import annotations

import random
import re

MARKED = """
please call me at <phone (212) 555-0147> tomorrow
you can call <phone 415-555-0132> or write to the office
phone: <phone 303 555 0199> after six
tel. <phone 0171 555 0123> for details
my phone is <phone 212.555.0186> and my fax is <phone 212.555.0187>
call <phone (646) 555-0110> now
telephone <phone 020 7946 0958> or visit us
mobile <phone 07700 900123> any time
Anruf unter <phone 030 555 0172> bitte
appelez le <phone 01 55 55 01 34> demain
llame al <phone 91 555 0128> hoy
write to <email jane (at) example (dot) org> please
mail <email bob [at] example [dot] com> for help
contact <email anna(at)example(dot)net> today
reach <email joe (at) site (dot) org> now
my address is <email lee (at) mail (dot) net> or
ask <email tim [at] post [dot] com> and
send it to <email sales (at) example (dot) com> or call
e-mail: <email info [at] example [dot] org> for more
Mr. <name John Miller> came to the house
Mrs. <name Anna Smith> wrote the letter
Ms. <name Carol Jones> and Mr. <name Paul Brown> agreed
Dr. <name Peter Weber> will see you now
Prof. <name Maria Rossi> gave the talk
we met Dr. <name Alan Green> in the hall
Herr <name Hans Meier> ist hier
Frau <name Eva Braun> kommt morgen
Mme <name Claire Dupont> est partie
Sr. <name Juan Lopez> vive en la casa
Mrs. <name Ruth Clark> is here
Ms. <name Ellen White> left
Prof. <name Erik Berg> was there
Herr <name Otto Lang> kam
Frau <name Inge Vogel> blieb
Mme <name Anne Petit> est la
Sr. <name Luis Garcia> no vino
it ended on Monday. Dr. <name Martin Hill> spoke first
they left early. Dr. <name Susan Ward> stayed on
we asked Prof. <name Karl Fuchs> and Dr. <name Olga Ivanova> too
so it was. Mr. <name Frank Cole> came back
contact Mr. <name Henry Adams> at once
SSN <id 123-45-6789> is on file
ssn: <id 987-65-4321> was used
passport no. <id X1234567> expired
passport <id C0193847> was lost
the SSN <id 219-09-9999> belongs to him
license no. <id D5551234> was shown
the house was built in 1987 and sold in 2004 for 250000 dollars
see page 12 of volume 3, section 4.5
it was 25.4 degrees at 10:30 on 12-05-2019
version 2.0 of the GNU General Public License applies
This work is licensed under CC BY-NC 4.0.
All rights reserved.
Copyright 2021 Example Works
The rain in the north fell for 40 days and 40 nights
They said that the ship had left. Then the others came.
In the end, The Great Hall was closed and Nobody Knew why
Der Mann ging in das Haus und Die Frau blieb dort
La casa de los otros estaba en el centro y era grande
Le chat est dans la maison et les enfants sont partis
THE SHIP WAS LATE AND THE MEN WERE TIRED
IS!! ON!! THE!! HOUSE!! OF!! THEN!!
order 4711 was sent on 3 May with 15 items
it cost $45.00 or 40% less than 2018
the number 123456 came up 7 times in 1000 draws
Anna and Peter were there. Onder the tree, Maria slept
of it, the others. In the end, at the house, they ran. On and on. For the
was gone. The end. To be at sea, with the wind, is good. As for them, no
at the river of the north, they met. It was late. Onto the boat, at last
write to them. They came at noon. Who wrote it? Call it a day. Mail came late
please be at the office. Contact was lost. The fax broke. Phone calls came
de la casa, que es la mejor. Los otros no. El fin. Con todo, y sin nada
la fin. Les autres sont la. De la maison, elle est sortie. Une fois. Et puis
das Ende. Die anderen sind da. Von dem Haus, das er sah. Ein Mal. Und dann
Home Home Home Home Home Home Home Home Home Home
end. end. end. Kettle Kettle Kettle Kettle Kettle Kettle
Stone Stone Stone Stone Stone. Lamp Lamp Lamp Lamp Lamp
New Books From The Old House Are Here Now And Then
Erbs. Water fell on it. Ened. Night came. Onder. Ships left. Thed. Sand was here
Alle. Wind kam. Eres. Gold. Inden. Moon was late. Ander. Sal no vino. Aire. Mer est la
Once. Twice. Thrice, Then more. Any. Of. Reed. Inner, Outer. Ending. Tions. Here
the passport was new and the license was old, SSN cards are blue
and. On the was ein. Enti les the of Ration was
| a | b | 12 | 34 |
token = abc123 and key: 99-12
id 24be64439e and code 5ea7 were made
"""


def parse(marked: str) -> list[tuple[list[str], list[str]]]:
    """(words, labels) of each line; a word that holds part of a marked stretch has its label, with any mark that touches it."""
    out = []
    for line in filter(None, marked.splitlines()):
        text, kinds, at = "", [], 0
        for m in re.finditer(r"<(email|phone|name|id) ([^>]+)>", line):
            text += line[at : m.start()] + m[2]
            kinds += ["O"] * (len(text) - len(m[2]) - len(kinds)) + [m[1]] * len(m[2])
            at = m.end()
        text += line[at:]
        kinds += ["O"] * (len(text) - len(kinds))
        words = list(re.finditer(r"\S+", text))
        out.append(([m[0] for m in words], [next((k for k in kinds[m.start() : m.end()] if k != "O"), "O") for m in words]))
    return out


#: Common given names, and the family names, words and domains that fill the sentence forms.
GIVEN_NAMES = frozenset(
    """james john robert michael william david richard joseph thomas charles daniel matthew anthony mark donald steven paul andrew
    joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry
    justin scott brandon benjamin samuel frank gregory raymond alexander patrick jack dennis jerry peter henry adam nathan
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen nancy lisa betty margaret sandra ashley kimberly
    emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela anna brenda
    emma ruth katherine christine helen maria heather diane julie alice claire sophie marie pierre jean luc hans karl jürgen
    monika sabine ursula klaus wolfgang juan carlos luis miguel josé carmen isabel lucía pablo elena kate tom ben sam joe""".split()
)
FAMILY_NAMES = """Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor
Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson Walker Young Allen King Wright Scott Torres
Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts O'Brien O'Connor McDonald Müller Schmidt
Schneider Fischer Weber Meyer Wagner Becker Dubois Durand Leroy Moreau Fernández Muñoz Smith-Jones Rossi Novak Kowalski""".split()
NAME_FORMS = """
My name is {n} and I live here .
my name is {n}, I work in the north
I am {n}, the owner of the house
{n} wrote: it was late
Sincerely, {n}
Best regards, {n}
Kind regards {n}
yours truly, {n}
signed by {n} on Monday
Name: {n}
Full name: {n}
patient {n} was seen today
customer {n} asked for help
contact {n} at the office
please ask for {n} when you call
{t} {n} was late
{t} {n} said so
{t} {f} spoke for an hour
we saw {t} {f} at the station
as {t} {n} told us, the ship had left
on Friday {t} {n} and {t} {f} met
it is not known. {t} {n} left the town
the letter of {t} {f} was lost
author: {n}
my friend {n} came too
her husband {n} stayed at home
employee {n} was absent
attn: {n}
Dear {t} {f}, thank you for the letter
Dear {n}, we write to you again
""".strip().splitlines()
TITLES = "Mr. Mr Mrs. Mrs Ms. Ms Dr. Dr Prof. Professor Miss Sir Herr Frau Mme M. Sr. Sra.".split()
PHONE_FORMS = """
call {p} now|phone {p} after six|tel: {p}|Tel. {p}|my number is {p} .|text me on {p} please|reach us at {p} or write|mobile: {p}|fax {p}, open daily|you can phone {p} at night|cell {p}|the office line is {p}|ring {p} and ask|contact: {p}|phone number: {p}|{p} is my phone number|{p} (office)
""".strip().split("|")
PHONES = ["({a}) {b}-{c}", "{a}-{b}-{c}", "{a}.{b}.{c}", "{a} {b} {c}", "0{a} {b} {c}", "0{a}/{b}{c}", "1-{a}-{b}-{c}", "0{a}-{b}{c}", "{a}-{c}"]
EMAIL_FORMS = "write to {e} please|mail {e} for help|my email is {e} .|email: {e}|contact {e} today|send it to {e} now|reach me: {e}|you can email {e} or call|address: {e}|reply to {e}, thanks".split("|")
EMAILS = ["{u} (at) {d} (dot) {s}", "{u} [at] {d} [dot] {s}", "{u}(at){d}(dot){s}", "{u}[at]{d}[dot]{s}", "{u} AT {d} DOT {s}", "{u} (at) {d}.{s}", "{u} {{at}} {d} {{dot}} {s}"]
ID_FORMS = "SSN {i} is on file|ssn: {i}|social security number {i} was used|my SSN is {i} .|passport no. {j} expired|passport number {j}|Passport: {j}|license no. {j} was shown|driver license {j}|ID number {j} is mine|tax id {k}|member id: {j}|account number {k} was closed|the SSN {i} belongs to her|passport {j} was lost".split("|")
PLAIN_FORMS = """
{W} {w} the {w} of {w} {w} , and {w} was {w} .
{W}. {W} {w} {w} the {w}. {W}, {w} {w}.
in {y} the {w} had {m} {w} and {m} {w}
{W} {W} {W} and {W} {W}
the {w} was built in {y} for {m} {w}
section {m}.{m} of the {w}, page {m}
version {m}.{m}.{m} of {w}
it cost {m}.{m} or {m} less than {y}
{w}-{w} {w}_{w} {w}/{w} {w}={m}
at {m}:{m} the {w} {w} left, {w} said
{W} of the {W}: a {w} {w}
on {m}-{m}-{y} they {w} {w}
item {m} of {m}: {w} {w} ({m})
call it a {w}. phone calls {w}. contact {w} was {w}
my {w} is {w}, our number of {w} is {m}
dear {w}, the name of the {w} is {w}
write to {w}, mail the {w}, reach the {w}
the {w} at the {w} dot {w} at {w}
Regards to the {w}. Sincerely the {w} {w}
Mr {w} and Mrs {w} the {w}
{W}! {W}? {W}; the {W} {w} {m}
patient {w} and customer {w} id {w} account {w}
{m} {m} {m} {m}
| {w} | {m} | {m} |
{R}
{w} {w} {R} {w}
then {W} {W} {w} the {W}, {W} {W} {w}
best {w}. Kind {w}, signed {w} on {m}
""".strip().splitlines()
ROWS_OF_A_FORM = 7


def _invented(r: random.Random) -> str:
    return "".join(r.choice(["th", "er", "an", "ing", "on", "re", "st", "ion", "ei", "sch", "que", "os", "é", "ly", "ou", "wh", "a", "o", "un"]) for _ in range(r.randint(1, 4)))


def labelled(seed: int = 1, rows: int = ROWS_OF_A_FORM) -> list[tuple[list[str], list[str]]]:
    """The sentences of MARKED and `rows` of each form with invented fillings: (words, labels) of each. Same seed, same table."""
    r = random.Random(seed)
    given = sorted(GIVEN_NAMES)

    def number(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def name() -> str:
        # Some names are of no list.
        first = r.choice(given).title() if r.random() < 0.65 else _invented(r).title()
        return f"<name {first} {r.choice(['', '', '', chr(65 + r.randrange(26)) + '. '])}{family()}>"

    def family() -> str:
        return r.choice(FAMILY_NAMES) if r.random() < 0.6 else _invented(r).title()

    def filled(form: str) -> str:
        made = form
        for slot, value in (
            ("{n}", name), ("{f}", lambda: f"<name {family()}>"), ("{t}", lambda: r.choice(TITLES)),
            ("{p}", lambda: "<phone " + r.choice(PHONES).format(a=number(r.choice([2, 3, 3])), b=number(r.choice([3, 3, 4])), c=number(4)) + ">"),
            ("{e}", lambda: "<email " + r.choice(EMAILS).format(u=r.choice(given) + r.choice(["", number(2), "." + r.choice(FAMILY_NAMES).lower()]), d=_invented(r), s=r.choice(["com", "org", "net", "io", "de", "edu"])) + ">"),
            ("{i}", lambda: f"<id {number(3)}-{number(2)}-{number(4)}>"), ("{j}", lambda: f"<id {r.choice('ABCDEFGHXYZ')}{number(r.choice([7, 8]))}>"), ("{k}", lambda: f"<id {number(2)}-{number(7)}>"),
            ("{R}", lambda: " ".join([_invented(r).title()] * r.randint(4, 12))), ("{w}", lambda: _invented(r)), ("{W}", lambda: _invented(r).title()), ("{m}", lambda: number(r.choice([1, 2, 3, 4, 6]))), ("{y}", lambda: str(r.randint(1700, 2030))),
        ):
            while slot in made:
                made = made.replace(slot, value(), 1)
        return made

    forms = NAME_FORMS + PHONE_FORMS + EMAIL_FORMS + ID_FORMS + PLAIN_FORMS * 4
    return parse(MARKED + "\n".join(filled(f) for f in forms for _ in range(rows)))
