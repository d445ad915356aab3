"""A small labelled table of sentences with and without personal data, from which the tagger is trained.

The sentences were written for this purpose; none comes from a table the tagger is used on (a test holds every run of four of their words
against the given descriptions). Names, streets, numbers and mail hosts are made by rule. Each kind of personal data stands in many settings and beside
things that look like it: places and goods named like persons, streets without a number, numbers of files and plans.
"""

from __future__ import annotations

import random
import re

KINDS = ("email", "phone", "id_number", "street_address", "person_name")

#: Sentences with marked places. {n} a person's name, {a} a street address, {p} a phone number, {e} an e-mail address,
#: {i} an identity number with its label before it; the others are no personal data.
WITH = """
Please thank {n} for the tour.
{n} signed the contract last {day}.
{n} and {n} bought it in {year}.
The estate of {n} is selling.
According to {n}, the {thing} dates from {year}.
Landlord: {n}.
Landlord: {n}, {i}.
Signed, {n}
Signed, {n}, {day}
Architect {n} designed the {thing}.
It was put up for {n} in {year}.
Deliver boxes to {n}, care of {n}.
Speak with {n} before {day}.
Our agent {n} replies within {d} days.
Neighbour {n} has the other set.
Witness: {n}, {a}.
{n} (tenant) pays the {thing} bill.
The {thing} came from {n} of {town}.
Attn {n}, {a}
c/o {n}, {a}.
Listed by {n}, {p}.
Listed by {n} - {p} - {e}
Broker {n} will meet you; dial {p}.
Photos by {n}.
In {year} {n} moved the {thing} indoors.
Later {n} gave the {thing} a {adj} coat.
Inspector {n} looked at the {thing} twice.
Then {n} (agent) let us in.
A note from {n}: the {thing} sticks.
Send {n} your offer.
Visit {n} or phone {p}.
Please contact {n}.
Contact {n} by {month}.
Contact {n}, {p}, or {n}, {p}.
Tenants {n} and {n} leave in {month}.
Superintendent {n} holds spare fobs.
Buyer {n} ({i}) waived it.
Renter {n}, {i}, has the upper flat.
We met {n} at the {thing}.
{n} runs the {adj} {thing} downstairs.
{n} lives above, {n} below.
Phone {p}.
Dial {p} after six.
Office line {p}, mobile {p}.
Fax {p}
Tel. {p}
Leave a message on {p}.
Days {p}; nights {p}.
For a viewing dial {p} or write to {e}.
Reception: {p}.
Ring {n} on {p}.
Reach {n} at {p}.
Reach us on {p}.
Ring twice, or text {p}.
Voicemail ({p}) is checked each {day}.
Hotline {p} / {e}
Questions? {p}
Questions? {e}
Send papers to {e}.
{e} answers fastest.
E-mail: {e}
Applications: {e}, {p}.
Inquiries via {e} only.
Mail {e} with a copy to {e}.
Write to {n} ({e}).
Use {e} for the floor plan.
Have your lender mail {e} by {day}.
Reply to {e}, please.
{i} was given by the applicant.
Applicant {n}, {i}.
The form lists {i}.
A copy of {i} is attached.
We hold {i} for {n}.
Verified: {i}.
Deed signed under {i}.
Lease names {n} with {i}.
Escrow asked {n} for {i}.
{i}; {p}
Meet us at {a}.
The office is at {a}.
Send rent to {a}.
Send rent to {a}; dial {p} first.
{a} comes with it.
Formerly of {a}, {n} now rents.
Starting from {a} go left.
Viewing at {a} on {day}.
Property: {a}.
Property: {a}, {town}
Stop by {a} any {day}.
Two doors from {a}.
It adjoins {a} and backs onto {a}.
Sister house of {a}.
{a} is the {adj} {thing} you saw.
The {adj} {thing} behind {a} is ours.
This {thing} at {a} needs a {adj} owner.
Pick up fobs from {n}, {a}.
Tenant of {a}, {i}.
{n} of {a}, {i}, pays in {month}.
The lot beside {a} is {adj}.
{e}
{e}
{p}
({p})
{a}
{n}
{n}, {p}
- {n}, {p}
{n}, {e}
{i}
""".strip().splitlines()

WITHOUT = """
{cap} {place} is around the corner.
Close to {cap} {place} and {cap} {place}.
Close to {cap} {place} and the {cap} {place}.
The {cap} {place} tram stops here.
{cap} {place} reopened in {year}.
{cap} {cap} {place} has {adj} benches.
Views reach {cap} {place} on clear days.
{d} blocks from {cap} {place}.
From the {cap} {place} it is a short ride to {cap} {place}.
{town} {place} and the {thing} are close.
Buses run to {town} {place} hourly.
A {cap} {good} and a {cap} {good} are left.
The {cap} {good} works well.
The {stuff} {cap} {good} dates from {year}.
With a {adj} {cap} {good} under the {thing}.
All {good} hardware is {cap} brand.
{cap} {good}, {stuff} counters, {adj} {thing}.
Its {cap} {good} came with the {stuff} {thing}.
Fittings from the {cap} {good} line.
{cap} style trim, {cap} type roof.
Off {street}, the {thing} is {adj}.
Between {street} and {street}.
{street} traffic is light.
Trees line {street} all the way to {street}.
No parking along {street} in {month}.
In {town}, shops close early.
{town} has {adj} winters.
Moving from {town} to {town} took {d} days.
Downtown {town} is {d} stops away.
{cap} and {cap} are names of cats here, says a sign on {street}.
Folio {file} lists the {thing}.
Docket {permit} was heard in {month}.
Plat {plan} shows a {adj} {thing}.
Deed book {dd} page {ddd}.
Account {file} covers the {thing}.
Tax map {parcel}, section {d}.
Serial {file} is on the {thing}.
MLS {file}, updated {day}.
Zoning case {permit}: approved.
Assessor id {parcel} for the {thing}.
Work order {permit} replaced the {thing}.
File {permit} is with the board.
See drawing {plan} for the {thing}.
Blueprint 555-{dd} has a {adj} {thing}.
Layout 555-{dd} or 555-{d}, your choice.
The tank holds {dddd} litres.
Model {plan} {good}, {dd} amps.
{dddd} square metres in all, {d} floors.
{dd} by {ddd} metres, {dddd} in total.
Priced {money}, was {money}.
Rent is {ddd} a week or {dddd} a month.
Fees: {ddd}, due each {month}.
Only {d} Blocks to the water.
{dd} Windows face the {thing}.
{dd} {Title} at the back.
{Title} {Title}, {Title} {Title}.
{Title} {Title}: {adj}.
{Title} {Title} and {Title} {Title}
- {Title} {Title}
* {Title} {thing}
{Title} {thing}, {adj} {thing}
New {Title} in {year}
No owner lives here.
The agent has no key.
Ask the manager about the {thing}.
Call ahead, for the {thing} is {adj}.
Please write a short letter.
Contact the office during the week.
Tenant pays heat; landlord pays water.
Buyers should look at the {thing}.
The seller will repair the {thing} at closing.
Phone and mail service were cut in {year}.
Passport offices and schools are near.
Bring a license or other papers.
Aim at dotted lines on the plan.
Ceilings rise to {d} metres.
It has a {adj} {thing} and a {adj} {thing}.
The {thing} was {verb} in {year}.
{month} is {adj} here.
By {day} the {thing} is {verb}.
We {verb} the {thing} and the {thing}.
Its {thing}, {adj} and {adj}, faces the {thing}.
Behind the {thing} lies a {adj} {thing}.
You enter through a {stuff} {thing}.
Past the {thing} is a {thing} of {stuff}.
Some {adj} {thing} with {stuff} trim.
Nothing {adj} about this {thing}: it is {adj}.
Heat: {stuff}. Roof: {stuff}.
Heat {d} zones, {dd} panels, {stuff} flooring.
Pets: ask. Smoking: no.
Act fast.
Sold as seen.
(end of text)
Taxes {money}; insurance {money} in {year}.
A {adj} home that any {who} would like.
For the {who}, the {thing} is {adj}.
Each {who} gets a {thing} in the {thing}.
Tucked near {street}, with {adj} light.
Where {street} meets {street} there is a {place}.
Steps to {place} and {place}.
This {adj} {thing} spans {dddd} square feet.
Has {d} beds, {d} baths, {dddd} sq ft.
""".strip().splitlines()

#: What looks like personal data and is none, for sentences made by rule, and the small words of those.
LIKE = """
{cap} {place}
the {cap} {place}
{cap} {cap} {place}
{cap} {place} {place}
{cap} {good}
a {cap} {good}
{stuff} {cap} {good}
{street}
{town}
in {town}
near {town}
to {town}
{town} and {town}
{town} {place}
{Title} {Title}
{Title} {thing}
{number} {file}
{number} {permit}
{number} {plan}
{number} {parcel}
{number} no. {file}
{number} 555-{dd}
{number} {dd}
{d} {thing}
{d} {thing}s
{dd} {thing}s
{dd} {Title}
{ddd} sq ft
{dddd} sq ft
{ddd} {measure}
{dd} x {ddd} {measure}
{dd} by {dd} {measure}
{d}.5 {thing}
{money}
{month} {year}
{day}
{year}
""".strip().splitlines()
SMALL = "the a an of in on at by to for with from into onto up down off out through throughout between behind beside along around about above below under over near next past after before during until since then and or but nor so as if than that which who whom while when where why how i you he she it we they me him her us them my your his its our their this these those is am are was were be been being has have had do does did will would shall should can could may might must not no yes only also both each every any some all most many much more few less other another such same very too just still yet here there now once again one two three four five six seven eight nine ten first second last".split()

#: Words that fill the sentences. Some are replaced by made ones, so that no sentence hangs on a word.
WORDS = {
    "month": "January February March April May June July August September October November December".split(),
    "day": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "adj": "big,little,old,new,dry,damp,clean,dark,pale,wide,tall,short,square,round,steep,flat,plain,fine,cheap,rare,green,blue,white,fresh,solid,sturdy,sunny,shady,breezy,chilly,lovely,very nice,rather small,fully fitted,really neat".split(","),
    "thing": "porch,shed,garden,window,staircase,lift,cellar,fence,oven,garage,shower,hall,terrace,lawn,drain,ceiling,wardrobe,cupboard,radiator,shutter,gate,barn,meter,pump,shelf,awning,sink,stove,vent,door,wall,path,corner room,spare bed,upper floor,rear door,front gate".split(","),
    "stuff": "steel glass stone timber plaster leather rubber vinyl iron brass granite concrete cotton wool gas oil".split(),
    "who": "family,couple,chef,nurse,teacher,writer,runner,artist,investor,builder,baker,sailor".split(","),
    "verb": "painted fixed moved swapped cleaned sanded raised lowered lined fitted removed measured".split(),
    "Title": "Modern Classic Open Private Great Grand Large Covered Heated Central Double Hidden Walls Views Rooms Pool Floors Plan Storage Yard Details Charm Light Air Windows Doors Steps Closets Stairs Cabinets Parking Garage Location Schools".split(),
}
#: Lists of general words, seen as features: what follows a place's or a good's name, who is named, how one is reached, what numbers are labelled with.
PLACE_WORDS = frozenset(
    "park playground garden gardens square plaza corner hall library school academy college university church chapel temple mosque synagogue market grocery grocer bakery cafe café coffee diner bar tavern pub restaurant deli kitchen station stop terminal depot bridge tunnel pier wharf harbor bay beach pond lake river creek brook hill hills heights ridge valley woods forest trail path greenway reservation museum gallery theater theatre cinema stadium arena gym pool hospital clinic pharmacy bank hotel inn mall center centre tower towers building house houses estate estates village district quarter common commons field fields court green mill farm cemetery monument statue fountain lighthouse airport county city town neighborhood island point shore club lodge zoo".split()
)
GOODS_WORDS = frozenset(
    "series range lamp oven stove cooktop hob fridge refrigerator freezer dishwasher washer dryer sink faucet tub bath shower toilet vanity cabinet cabinets cabinetry chandelier sconce pendant fan thermostat boiler furnace heater grill sofa couch chair table desk bed piano mirror clock stereo speaker system model edition collection line brand appliance appliances tile tiles wallpaper paint carpet rug curtain blinds shade shades door lock engine mower".split()
)
ROLE_WORDS = frozenset(
    "owner owners tenant tenants seller sellers buyer buyers landlord landlady agent agents broker realtor manager superintendent caretaker janitor heir heirs applicant renter renters occupant resident neighbor neighbour architect builder contractor inspector attorney lawyer notary trustee executor witness photographer contact host lessee lessor client officer".split()
)
REACH_WORDS = frozenset("call calls text texts ask phone ring dial email e-mail mail write contact reach tel telephone fax mobile cell voicemail whatsapp message msg attn reply speak visit".split())
ID_WORDS = frozenset("ssn social security sec soc taxpayer tin itin tax passport driver drivers driver's license licence dl identity".split())
COUNT_WORDS = frozenset("parcel parcels permit permits lot plan plans file files listing mls folio docket plat deed book page account map section serial case order drawing blueprint layout model folder record invoice zoning apn block series measures square sq ft feet about circa built bed beds bedroom bedrooms bath baths bathroom bathrooms rooms floors stories storeys levels units acres years".split())
TITLES = ("Mr.", "Mrs", "Mrs.", "Ms.", "Dr.", "Mr", "Ms", "Dr", "Prof.")
STREET_TYPES = "Street St St. Str Avenue Ave Ave. Av Road Rd Rd. Lane Ln La Drive Dr Drv Boulevard Blvd Boul Court Ct Crt Place Pl Plc Terrace Ter Terr Square Sq Sq. Circle Cir Circ Way Wy Parkway Pkwy Pky".split()
SIDES = "N S E W N. S. E. W. North South East West No. So.".split()
HEADS = "Fort Ft Ft. Mount Mt Mt. Saint St St. Ste Ste.".split()
UNITS = ("Apt", "apt", "Apt.", "Unit", "UNIT", "Ste", "Fl", "#", "# ", "Suite", "Floor")
_START, _MID, _END = "b br d f g gr h j k l m n p r s t tr v w z".split(), "a e i o u ai ea".split(), ["", "l", "m", "n", "r", "s", "t", "ck", "nd"]


class Maker:
    """Fills sentences with invented values."""

    def __init__(self, given: list[str], seed: int):
        self.r, self.given = random.Random(seed), given

    def word(self, low: int = 2, high: int = 3) -> str:
        pick = self.r.choice
        return "".join(pick(_START) + pick(_MID) + pick(_END) for _ in range(self.r.randint(low, high))).capitalize()

    def first(self) -> str:
        w = self.r.choice(self.given) if self.given and self.r.random() < 0.45 else self.word(1, 2)
        return w if self.r.random() < 0.9 else w.translate(str.maketrans("eouan", self.r.choice(["éöüáñ", "èøúãñ"])))

    def n(self) -> str:
        family = self.word() + (f"-{self.word()}" if self.r.random() < 0.15 else "")
        k = self.r.random()
        if k < 0.5:
            out = f"{self.first()} {family}"
        elif k < 0.6:
            out = f"{self.first()} {self.word(1, 1)[0]}. {family}"
        elif k < 0.7:
            out = f"{self.word(1, 1)[0]}. {family}"
        elif k < 0.85:
            out = f"{family}, {self.first()}"
        else:
            return f"{self.r.choice(TITLES)} [person_name|{family}]"
        return f"[person_name|{out.upper() if self.r.random() < 0.06 else out}]"

    def a(self) -> str:
        r = self.r
        number = str(r.randint(1, 199))
        k = r.random()
        number += "" if k < 0.88 else r.choice(["A", "a", "-A", " A", " B"]) if k < 0.94 else r.choice(["-", " - ", " & "]) + str(int(number) + 1)
        words = [r.choice(SIDES)] if r.random() < 0.15 else []
        words += [r.choice(HEADS)] if r.random() < 0.1 else []
        words.append(r.choice(["Main", "High", "Oak", "Elm", "Mill", "Park", "Church", "Union"]) if r.random() < 0.1 else self.word(2, 4))
        words += [r.choice(STREET_TYPES)] if r.random() < 0.85 else []
        words += [r.choice(SIDES)] if r.random() < 0.05 and len(words) > 1 else []
        unit = ""
        if r.random() < 0.3:
            unit = r.choice([", ", " "]) + r.choice(UNITS)
            unit += ("" if unit.endswith(("#", " ")) else " ") + r.choice([str(r.randint(1, 999)), f"{r.randint(1, 9)}{r.choice('ABCDR')}"])
        return f"[street_address|{number} {' '.join(words)}{unit}]"

    def p(self) -> str:
        r = self.r
        area, last = str(r.randint(201, 989)), f"{r.randint(0, 9999):04}"
        middle = r.choice(["555", str(r.randint(200, 999))])
        k = r.choice(["-", ".", " ", "/", "()", "() ", "", "local"])
        if k == "local":
            out = f"{middle}-{last}"
        elif k.startswith("("):
            out = r.choice(["", "", "1 ", "+1 "]) + f"({area}){k[2:]}{middle}-{last}"
        elif k == "":
            out = r.choice(["", "+1"]) + f"{area}{middle}{last}"
        elif k == "/":
            out = f"{area}/{middle}-{last}"
        else:
            out = r.choice(["", "", "+1" + k, "1" + k, "001" + k]) + f"{area}{k}{middle}{k}{last}"
        if r.random() < 0.15:
            out += r.choice([" ext. ", " ext ", " x", " extension "]) + str(r.randint(1, 999))
        return f"[phone|{out}]"

    def e(self) -> str:
        r, low = self.r, lambda: self.word(1, 3).lower()
        local = r.choice([low(), f"{low()}.{low()}", f"{low()}{r.randint(10, 99)}", f"{low()}_{low()[0]}", f"{low()}+{low()}", f"{low()}-{low()}", f"{low()}.{r.randint(1940, 2005)}", low()[0] + low()])
        host = f"{low()}{r.choice(['', '', '.' + low()])}.{r.choice(['com', 'org', 'net', 'info', 'example', 'test', 'invalid', 'us'])}"
        k = r.random()
        out = f"{local}@{host}" if k < 0.8 else f"{local} @ {host}" if k < 0.87 else f"{local} [at] {host}" if k < 0.93 else f"{local} at {host.replace('.', ' dot ')}"
        return f"[email|{out}]"

    def i(self) -> str:
        r = self.r
        a, b, c = r.randint(100, 999), r.randint(0, 99), r.randint(0, 9999)
        letters, x = "".join(r.choice("ABCDEFGHKLMNPQRSTUVWXYZ") for _ in range(2)), r.choice("ABCDEFGHKLMNPQRSTUVWXYZ")
        nine = r.choice([f"{a}-{b:02}-{c:04}", f"{a}{b:02}{c:04}", f"{a} {b:02} {c:04}", f"{a}.{b:02}.{c:04}"])
        label, number = r.choice(
            [
                (["SSN", "SSN:", "ssn", "SSN#", "social security number", "social security no.", "soc. sec. no.", "soc sec", "social security"], nine),
                (["taxpayer id", "taxpayer number", "tax id", "TIN", "ITIN", "TIN:"], r.choice([nine, f"{b:02}-{r.randint(1000000, 9999999)}"])),
                (["passport", "passport no.", "passport number", "Passport:"], r.choice([f"{letters} {r.randint(1000000, 9999999)}", f"{letters}{r.randint(100000, 9999999)}", f"{x}{r.randint(1000000, 99999999)}", str(r.randint(10000000, 999999999))])),
                (["driver license", "driver's license", "drivers license", "driver licence no.", "DL", "DL#", "license no."], r.choice([f"{x}{r.randint(100, 999)}-{r.randint(0, 9999):04}-{r.randint(1000, 9999)}", f"{x}{r.randint(1000000, 99999999)}", f"{x}{a} {c:04}", str(r.randint(1000000, 999999999))])),
            ]
        )
        return f"{r.choice(label)} [id_number|{number}]"

    def fill(self, pattern: str) -> str:
        r = self.r
        rules = {
            "cap": self.first,
            "town": lambda: self.word(1, 2) + r.choice(["", "ton", " Falls", " Grove", "ford", " Springs", " Junction"]),
            "street": lambda: self.word(2, 4) + " " + r.choice(STREET_TYPES[:12]).rstrip("."),
            "number": lambda: r.choice([str, str.capitalize])(r.choice(sorted(COUNT_WORDS))),
            "measure": lambda: r.choice(["ft", "feet", "m", "metres", "yards", "sq ft", "sf", "percent", "years", "rooms", "units"]),
            "place": lambda: r.choice([str.capitalize, str])(r.choice(sorted(PLACE_WORDS))),
            "good": lambda: r.choice(sorted(GOODS_WORDS)),
            "d": lambda: str(r.randint(1, 9)), "dd": lambda: str(r.randint(10, 99)), "ddd": lambda: str(r.randint(100, 999)), "dddd": lambda: r.choice(["", ","]).join([str(r.randint(1, 9)), f"{r.randint(0, 999):03}"]),
            "year": lambda: str(r.randint(1850, 2026)), "money": lambda: r.choice(["$", "", "USD "]) + r.choice([f"{r.randint(1, 9)},{r.randint(0, 999):03},000", f"{r.randint(100, 999)},{r.randint(0, 999):03}", str(r.randint(200, 9999))]), "permit": lambda: f"{r.choice(['', 'B', 'E-'])}{r.randint(1990, 2099)}-{r.randint(100, 999)}-{r.randint(0, 9999):04}",
            "parcel": lambda: str(r.randint(0, 9999999999)).zfill(10), "file": lambda: str(r.randint(100000, 99999999)), "plan": lambda: f"{r.choice('ABCDFGHKMPRTVXZ')}{r.randint(1, 99)}-{r.randint(100, 99999)}",
        }

        def one(m: re.Match) -> str:
            key = m[1]
            if key in "naepi":
                return getattr(self, key)()
            if key in rules:
                return rules[key]()
            if key not in ("month", "day", "Title") and r.random() < 0.4:
                return self.word(1, 3).lower() + (f"-{self.word(1, 2).lower()}" if r.random() < 0.4 else "")
            return r.choice(WORDS[key])

        return re.sub(r"\{(\w+)\}", one, pattern)

    def plain(self) -> str:
        """A word of no meaning here, or one of the general lists."""
        r, k = self.r, self.r.random()
        if k < 0.35:
            return self.word(1, 3).lower()
        if k < 0.45:
            return f"{self.word(1, 2).lower()}-{self.word(1, 2).lower()}"
        if k < 0.75:
            return r.choice(SMALL)
        return r.choice(r.choice([WORDS["thing"], WORDS["adj"], WORDS["stuff"], WORDS["who"], WORDS["verb"], sorted(ROLE_WORDS), sorted(REACH_WORDS), sorted(COUNT_WORDS), sorted(PLACE_WORDS)]))

    def sentence(self) -> str:
        """A sentence made by rule: up to three items or things like them among words of no meaning."""
        r, out = self.r, []
        words = lambda least: " ".join(self.plain() for _ in range(r.randint(least, 5)))
        if r.random() < 0.75:
            out.append(words(1))
        for k in range(r.choice([0, 1, 1, 1, 2, 2, 3])):
            item = self.fill("{" + r.choice("nnnnapei") + "}" if r.random() < 0.6 else r.choice(LIKE))
            if k and r.random() < 0.4:
                out[-1] += r.choice([",", ":", ";", " -", " /", " and", " or", " &", ""])
            elif k:
                out.append(words(1))
            if r.random() < 0.1:
                item = f"({item})"
            out.append(item)
            if r.random() < 0.15:
                out[-1] += r.choice([",", ":", ";", " -"])
        if r.random() < 0.6 or not out:
            out.append(words(1))
        text = " ".join(out)
        if not text.startswith(("[", "(")) and r.random() < 0.9:
            text = text[0].upper() + text[1:]
        return text + r.choice([".", ".", ".", ".", "", "!", "?", "..."])


def labelled_texts(given: list[str], rows: int = 2500, seed: int = 5, with_: list[str] | None = None, without: list[str] | None = None, made: float = 0.5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``rows`` short texts, each of a few sentences, a share ``made`` of them by rule, and the spans (start, end, kind) of the personal data in them."""
    make, out = Maker(given, seed), []
    r, with_, without = make.r, with_ or WITH, without or WITHOUT
    for _ in range(rows):
        parts = []
        for _ in range(r.randint(2, 5)):
            parts.append(make.sentence() if r.random() < made else make.fill(r.choice(with_ if r.random() < 0.55 else without)))
            if r.random() < 0.1 and "[" not in parts[-1]:  # as texts are edited: words put in, points left out
                words = parts[-1].split(" ")
                words.insert(r.randrange(len(words)), r.choice(WORDS["adj"] + WORDS["thing"]))
                parts[-1] = " ".join(words)
            if r.random() < 0.1:
                parts[-1] = parts[-1].replace(" and ", r.choice([" & ", " &amp; "]), 1)
            if r.random() < 0.05:
                parts[-1] = parts[-1].removesuffix(".")
        if r.random() < 0.25:
            parts = [f"- {p}" for p in parts]
        text, spans, marked = "", [], r.choice([" ", " ", "  ", "\n"]).join(parts)
        at = 0
        for m in re.finditer(r"\[(\w+)\|((?:[^\]\[]|\[at\])*)\]", marked):
            text += marked[at : m.start()]
            spans.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        text += marked[at:]
        case = r.random()
        text = text.upper() if case < 0.1 and len(text.upper()) == len(text) else text.lower() if case > 0.84 and len(text.lower()) == len(text) else text
        out.append((text, spans))
    return out
