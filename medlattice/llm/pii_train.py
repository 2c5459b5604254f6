"""Trains the model of pii_crf.py on sentences made here, and writes pii_weights.json.

    python -m medlattice.llm.pii_train

The sample is bounded (SENTENCES) and labelled by construction: frames with slots are filled with made-up values. Nothing
is read from any table. The frames cover how clinical notes mention people, and what looks alike but is not personal.
"""

from __future__ import annotations

import json
import random
import re
from pathlib import Path

from .pii_crf import fit

SENTENCES, SEED = 7000, 5

_FIRST = "Élodie Åsa Øyvind Ángel Anna Maria James John Peter Susan Linda Omar Fatima Wei Chen Elena Ivan Tomas Helga Priya Ravi Aisha Noah Emma Lucas Mia Hugo Ines Karl Greta Sven Olga Piotr Yuki".split()
_LAST = "Smith Jones Taylor Brown Walker Hill Park Bell Young Long Day Rose King Miller Baker Garcia Lopez Kowalski Novak Rossi Meyer Schmidt Nguyen Tanaka Singh Khan Hughes Morgan Okafor".split()
_SYL_A = "ba bel bran cal dor el fen gar hal jor kel lan mar nor ol pel quin ral sel tor ul var wen yor zel tav mos cor dra hol rus sten vor nes jas gre lor".split()
_SYL_B = "a an ar e el en er i il in o on or u ra la na mo ve".split()
_SYL_C = "bert dan den dil don fold gard hart ick ida ine ira lind lock man mar mond nor ora rick rin sa sen son strom ton va vin wick win wyn ley ney by".split()
_STREET_A = "Ash Birch Cedar Mill Church Station Victoria Queens Maple Oak River Meadow Castle Garden North Lower Long High West Bridge Abbey Orchard".split()
_STREET_B = "ford wood field mere ham bury ton worth stead den dale haven moor leigh gate".split()
_KIND = "Street St Road Rd Lane Ln Avenue Ave Drive Dr Close Court Ct Crescent Terrace Boulevard Blvd Way Place Square Row Grove Gardens Walk Hill".split()
_DRUG = "stat pril olol mab cillin sartan azole idone ipine oxacin amide tinib parin gliptin zepam cort".split()

_NOUN = (
    "gait speech hearing vision balance strength reflexes tone posture swallowing intake output appetite sleep mood pulse weight height urine stool skin "
    "sodium potassium calcium glucose lactate albumin ferritin bilirubin troponin creatinine haemoglobin urea phosphate magnesium cholesterol platelets "
    "anaemia asthma arthritis bronchitis pancreatitis hepatitis vasculitis colitis osteoporosis cirrhosis sarcoidosis sepsis eczema glaucoma psoriasis epilepsy "
    "migraine gout angina pneumonia hypothyroidism endometriosis nausea dizziness tingling numbness swelling fatigue headache sutures dressing drain "
    "physiotherapy pharmacy radiology dietetics surgery occupational laparoscopy bronchoscopy colonoscopy endoscopy echocardiography dialysis oxygen contrast"
).split()

#: A slot in braces; * marks slots whose value is personal. All wording is invented.
FRAMES = """
{full*} came to the clinic with her sister.|{full*} was admitted from home.|{full*} reports less pain today.|{full*} denied any fever.|{full*} is a retired cook.|{full*} agreed to the plan.|{full*} said the tablets helped.
{full*} was driven here by a friend.|{full*} on the late shift.|{full*} at the front desk.|{full*} to follow.
Today {full*} walked without help.|Yesterday {full*} slept well.|At noon {full*} was given lunch.|In the corridor {full*} stood up alone.|During the visit {full*} wept.|After lunch {sur*} was calmer.|Later that day {full*} went home.|Before discharge, {full*} called a taxi.
Overnight {sur*} was comfortable.|Since then {sur*} has improved.|Afterwards {sur*} ate a little.|Later {sur*} walked to the door.|Then {sur*} asked for water.|Meanwhile {sur*} waited outside.|Today {sur*} looks well.|Now {sur*} is at home.
{sur*} lives with a dog.|{sur*} said she was better.
{Noun} was normal.|{Noun} was low.|{Noun} is unchanged.|{Noun} was {d2} and {noun} was {d2}.|{Noun} peaked at {d2}.|{Noun} was thought less likely.|{Noun} was {d3} mL.|{Noun} will continue as before.|{Noun} asked for a repeat.|{Noun} came back twice.|{Noun} in 2015 was normal.|{Noun} and {noun} were discussed.|{Noun} at the knee is healing.|{Noun} comes and goes.|{Noun}, {noun} and {noun} were noted.|{Noun} of the hip is mild.|{Noun} improved.|{Noun} for suspected {noun}.|{Noun} will review the scan.|{Noun} over the chest was cool.|Two samples were sent.|Three films were lost.
Mr {sur*} is stable.|Mrs {sur*} likes the early slot.|Ms {sur*} lives with her mother.|Miss {sur*} eats well.|Mr. {sur*} declined the scan.|Dr. {sur*} will see the wound.|Dr. {sur*} will call.|Mr. {sur*} was kept in.|Ms. {sur*} agreed.|Prof. {sur*} was asked.|Mrs. {full*} was told.|Dr {sur*} reviewed the film.|Dr. {full*} will call back.|Prof {sur*} agreed.|Prof. {full*} gave advice.|Nurse {sur*} changed the dressing.|Sister {sur*} took over on the unit.|Sister {sur*} spoke to the family.|Nurse {full*} signed as witness.|Doctor {sur*} was paged.
Mr {sur*} and Mrs {sur*} came together.|Dr {full*} and Nurse {sur*} were present.
Referred by Dr {full*} for review.|Sent by Dr {inv*} for a second look.|Seen with Dr. {full*} on the round.|Seen by {full*}, MD.|Reported by {full*}, MD.|Dictated but not read by {inv*}, MD.|Written by {full*} RN.|Checked by {full*}, PhD.
Signed: {full*}|Electronically signed by {full*}|Signature: {inv*}|cc: {full*}|cc: Dr {full*}|Copy: {inv*}|Attending physician: {full*}|Consultant: {full*}|Surgeon: {inv*}|Patient: {full*}|Name: {full*}|Name of patient: {inv*}.|Patient name: {full*}.|Attending: {full*}|Author: {full*}
Next of kin: {full*} (wife).|Next of kin is {full*} (mother).|Emergency contact is {full*} (son).|Her husband {full*} drives.|His wife {full*} called.|His brother {sur*} was here.|The daughter, {full*}, came along.|The son, {inv*}, was told.|Her mother, {full*}, is well.|The carer {full*} helps.|Her partner {full*} fills the pill box.
Thank you for seeing {full*} in your clinic.|Thank you for referring {inv*} to us.|I talked to {full*} on the telephone.|We spoke with {full*} about the plan.|Letter prepared for {full*} and posted.|A note for {inv*} was left.|The taxi was booked for {full*}.|Met {full*} at the bedside.|Please ask {full*} to ring.|Discussed with {full*} and the team.
Later {sur*} smiled. Signed: {full*}|Attending: {full*} Later {sur*} slept.|cc: {full*} Today {sur*} ate well.|Consultant: {full*} Weight was {d2} kg.|cc: {full*}  Sleep is poor.|Signed electronically: {full*} Blood pressure was 120/80.|cc: {full*},PLAN
E-mail: {email*}|Email {email*} for copies.|Write to {email*}, please.|Contact {email*} with questions|Reach her at {email*} after six.|Results go to <{email*}> on request.|Login is {email*} and active.|The family can be written to at {email*} at any time.|Mail results to {email*}.|Reach his wife via {email*} before noon.|Reachable via {email*} at night.|Reply via {email*}, thanks.|Known as {email*} there.|Try {email*} first.|Answers go to {email*}, not to us.|send it to {email*} for the films|Copy sent to <{email*}>.|{email*} is the best address.
The pump was set at {t}.|Pulse was counted at {t} again.|Seen at {t} and at {t}.|Give it at {t} sharp.|Dose @ {t} and @ {t}.|pain at rest was 3.5 of 10.
Tel: {phone*}|Tel: {phone*} (mornings).|Phone {phone*}.|Call {phone*} if it bleeds.|Mobile {phone*}|mobile: {phone*}|Home telephone {phone*}.|Fax {phone*}.|Fax the letter to {phone*}, please.|She gave {phone*} as her number.|He left {phone*} for a call back.|The daughter can be reached on {phone*}.|Ring {phone*} ext 4 for the ward.|Ring {phone*} x22.|Contact number: {phone*}|Her number {phone*} was checked.|A text was sent to {phone*} today.|{phone*} works best before six.|{phone*} is his work line.|Message left on {phone*} twice.|Reminder went to {phone*}.|Pager {phone*}.|Best reached at {phone*} after work.
Lot {phonelike} was opened.|Lot {phonelike} of contrast was used.|Batch {phonelike} was recalled.|Film {short7} was reviewed.|Film series {short7} was shown.|Series {short7} was loaded.|Part {ssnlike} was replaced.|Item {ssnlike} was used.|Catalogue number {ssnlike} was ordered.|Implant item {ssnlike} is in place.|Catalogue item {ssnlike} of the implant.|Serial {n8} is on the pump.|Device {n8} was reset.|The monitor, serial {ln8}, failed.|Job {n7} was closed.|Work order {n7} for the bed.|The bed was serviced under job {n7}.|Invoice {n8} was paid.|Study code {nct} applies.|Trial {nct} is open.|Protocol {nct} was followed.|Protocol code {nct} holds here.|Registered as {nct}.|Slide {ln7} was stained.|Specimen {n8} was sent.|Accession {n8} was logged.|Lot no. {ln7} was drawn up.|Batch {n8} expired.|Order {ln8} was cancelled.|Model {short7} was chosen.|Version {ssnlike} of the form.|Kit {ln7} was opened.|Reagent {phonelike} ran out.|Image {n8} was saved.|Asset {n7} was moved.
Masked number XXX-XX-{d4} on the form.|SSN ***-**-{d4}.|Phone xxx-xxx-{d4}.|Card ending {d4}.|Count was {n6} cells.|Platelets {n6} per mL.|Reads of {n7} were aligned.
SSN {ssn*}.|SSN: {ssn*}|Social security number {ssn*} was given.|Social security no. {ssn*}|Her social security number is {ssn*}.|National insurance number {nino*}.|National number {ssn*} was read out.|The national number on file is {ssn*}.|National ID {n9*} seen.|The card says {ssn*}.|The card reads {ssn*}.|National number on the card is {ssn*}.|Number on the national card: {ssn*}
MRN: {n8*}|MRN {ln7*}|MRN#{n8*} / room 3|MRN #{n7*}.|Medical record number {n8*}.|Record {n7*} was opened.|Record no. {ln7*} was merged.|Chart {n8*} was pulled.|Chart no. {n8*} was found.|Chart no. {ln7*} was filed.|Patient ID {n8*} was checked.|Patient ID: {ln7*}|Patient number {n8*} confirmed.|Hospital number {ln7*}.|Case file {n8*} was requested.|Notes {ln7*} were requested.
Insurance number {pol*}.|Insurance ID {pol*} is valid.|Insurance member no. {pol*}.|Policy {pol*} runs out in May.|Policy ID: {pol*}, paid.|Policy number {n9*}.|Member ID {pol*}.|Passport {ln7*} was seen.|Passport no {ln7*} was copied.|Passport number: {n9*}|Identity card {ln7*} was shown.|ID card {ln8*} was scanned.|Identity number {n9*}.|Driving licence {ln8*} shown.
Lives at {addr*}.|Lives at {addr*} with her son.|Home address: {addr*}, {town}.|Address: {addr*}, {town}.|Address on record is {addr*}.|Discharged home to {addr*}, {town}.|Went to {addr*}.|Moved from {addr*} in May.|Moved to {addr*} last winter.|Post the splint to Flat {d1}, {addr*}, {town}.|Send it to Apartment {d2}, {addr*}.|The nurse will visit {addr*} on Friday.|The nurse will go to {addr*} at noon.|Deliver the bed to {addr*} (back door).|Oxygen goes to {addr*}, side gate.|She fell outside {addr*}.|Found at {addr*} by police.|Resident of {addr*}.|Visits at {addr*} weekly.
A {d1} {Dev} Drive cable was fitted.|The {d2} Lead Drive unit was swapped.|A {d1} Way Stop Cock was used.|A {d1} Way tap was placed.|A {d2} Channel Way board failed.|{d1} Point Place holder was set.|After 3 Close calls he stopped.|The {d1} Step Drive test went well.|A {d2} Row Grid Square was drawn.|A {d1} Port Way block was fixed.|We saw {d1} Main Street cases.
The {N} sign was absent.|The {N} sign was mild at the knee.|{N} sign was positive.|The {N} test was negative.|The {N} manoeuvre was painful.|The {N} manoeuvre provoked pain for {d2} seconds.|The {N} score was {d1}.|The {N} Score was {d2} and the Modified {N} Index was {d1}.|The Modified {N} Scale gave {d1}.|{N} Index of {d2}.|The {N} classification was used.|A size {d1} {N} catheter was left in.|A {N} drain was placed.|{N} syndrome was considered.|{N} disease was excluded.|The {N} procedure was done.|{N} grade {d1} changes.|The {N}-{N} criteria were met.|{N} forceps were used.|A {N} tube was passed.|The {N} protocol was used.|The {N} reflex was brisk.
Moved to the {N} Ward.|Transferred to {N} Court ward, bay {d1}.|The pump on {N} Court ward was serviced.|The Day Unit was full.|Handed over to the Night Team.|Seen on the {N} Unit.|The {N} Clinic is closed.|Bed {d1} on North Wing ward is free.|Sent to {N} Hospital.|The Heart Centre called.|Left Bundle Branch Block is known.|Right Anterior Cerebral Artery was patent.|Left Anterior Fascicular Block since 2015.|Chronic Kidney Disease stage 3.|Deep Vein Thrombosis was excluded.
{Drug} was started for pain.|{Drug} {d2} mg twice daily was given.|{Drug} was changed to {drug} {d2} mg.|We stopped {drug} after a week.|Allergy to {drug} is noted.|{Drug} and {drug} were held.|{Drug} helps.|Dose of {Drug} was cut.
FINDINGS: The liver is normal.|HISTORY|PLAN:|Impression|ASSESSMENT AND PLAN|Subjective|Objective: stable.|LABORATORY  Sodium was {d2}.|THE PATIENT WAS SEEN AND HAS NO COMPLAINTS.|WEIGHT WAS {d2} KG AND PULSE WAS {d2}.|Past History: none.|Family History: unknown.
Sister {place} took the overflow.|The sister {place} is shut.|Sister {place} will lend two beds.|Sister {Place} staff were told.|Our sister {place} keeps the list.|Sister {Place} took the night calls.|Sister {Place} sent two beds over.|Nurse Station {d1} was moved.|Doctor Room {d1} is free.|Doctors on {Place} {d1} agreed.
This {work} walks to work.|This {work} is {d2} years old.|That {work} sleeps badly.|The {work} stands all day.|A {work} of {d2} years.|Both {work}s were seen.|Each {noun} was noted.|No {noun} was seen.|These {noun}s were new.|Some {noun} remains.|All {noun} had gone.|Heavy {noun} was noted.|Light meals are taken.|Late meals bring {noun}.|An old {noun} was seen.|Any {noun} should be told.|Every {noun} was checked.|Her {noun} has eased.|His {noun} is worse.|Their {noun} was shared.|One {noun} was lost.|Several {noun}s were kept.
{Drug} {d2} mg three times a day.|{Drug} twice a day with meals.|Given four times a day for a week.|A band of {noun} runs along the edge.|A line of {noun} crosses it.|The {noun} lies {d1} cm from the {noun}.|A {noun} of {d1} mm was marked. Dr. {sur*} was told.|Lesions of {d1} mm were counted. Dr {sur*} will look.|Saturation was {d2} percent. Dr. ____ to sign.|Removal of the {noun} was planned.|The sigmoid colon was clear.|After a {noun} removal in {d2y}.
NHS number {nhs*}.|NHS no {nhs*} was checked.|NHS {nhs*} on the label.|Health card {nhs*}.|Health service number: {nhs*}
Blood pressure was {d2}/{d2}.|Pulse {d2}, temperature 37.{d1}.|Seen on 0{d1}/1{d1}/2018 for a check.|Seen on Monday and in March.|Imaging from 20{d2y} was compared.|Range of motion was {d2} degrees.|The scar is {d1} cm long.|Sutures come out in two weeks.|Urine was clear.|No mass is seen.|Sleep is broken.|Weight was {d2} kg.|She has asthma since 2004.|The man was told to rest.|There is mild swelling.|Walking now brings on pain after {d2} minutes.|Because of gout, surgery waits.|After surgery the knee healed.|Skin was warm.|Estimated blood loss was {d3} mL.|Review on Friday.|Given in January and June.|Back from Spain in April.|Speaks English and French.|Earlier gout was treated abroad in 2012.|Earlier scans are lost.|Diet is as before.|Contrast passed well.|Hearing was fine.|Neither drug helped.|Half of the tablets were left.|Examination of the neck was normal.|Mild pain was present.|Temperature rose to 38.{d1} on day {d1}.|Under local anaesthetic, a cyst was cut out.|Bronchoscopy in 2011 was normal.|Migraine comes monthly.|Family history is positive for stroke.|At the bedside the bladder was scanned.
"""


class _Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self, tail: list[str] | None = None) -> str:
        r = self.r
        x = r.choice(_SYL_A) + (r.choice(_SYL_B) if r.random() < 0.5 else "") + (r.choice(_SYL_A) if r.random() < 0.2 else "") + r.choice(tail or _SYL_C)
        return x.capitalize()

    def surname(self) -> str:
        r = self.r
        x = r.choice(_LAST) if r.random() < 0.3 else self.word()
        if r.random() < 0.08:
            x += "-" + (r.choice(_LAST) if r.random() < 0.5 else self.word())
        if r.random() < 0.04:
            x = r.choice(["O'", "Mc", "D'"]) + x
        if r.random() < 0.05:
            x = r.choice(["van ", "de ", "von ", "de la ", "al "]) + x
        return x

    def given(self) -> str:
        return self.r.choice(_FIRST) if self.r.random() < 0.3 else self.word(
            ["a", "en", "ia", "is", "o", "elle", "ith", "win", "mond", "sa", "in", "eth", "ick", "gar", "bel"]
        )

    def value(self, kind: str) -> str:
        r = self.r
        digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
        sep = lambda: r.choice("- ./")
        if kind == "full":
            middle = r.choice(
                [" ", " ", " ", f" {r.choice('ABCDEFGHJKLMNOPRSTUW')}. ", f" {r.choice('ABCDEFGHJKLMNOPRSTUW')} ", f" {self.given()} "]
            ) if r.random() < 0.5 else " "
            first = self.given() if r.random() < 0.88 else r.choice("ABCDEFGHJKLMNOPRSTUW") + "."
            x = f"{first}{middle}{self.surname()}"
            return self.inverted() if r.random() < 0.12 else x.upper() if r.random() < 0.05 else x
        if kind == "inv":
            return self.inverted() if r.random() < 0.6 else self.value("full")
        if kind == "sur":
            return self.surname()
        if kind == "email":
            a, b = self.given().lower(), self.word().lower()
            user = r.choice(
                [f"{a}.{b}", f"{a}_{b}", f"{a}{b}", f"{a[0]}{b}", f"{b}{digits(2)}", f"{b}+{a}", f"{a}.{b}{digits(2)}", f"{b}{r.randint(1940, 2005)}"]
            )
            host = [self.word().lower() + r.choice(["", "", digits(1)]), r.choice(["example", "test", "invalid", "com", "org", "net", "co.uk", "de"])]
            if r.random() < 0.15:
                host.insert(0, r.choice(["mail", "mx", "post"]))
            x = user + r.choice(["@"] * 7 + [" @ ", " (at) ", " [at] ", " at "]) + ".".join(host)
            if "@" not in x and r.random() < 0.7:
                x = re.sub(r"\.(?=[^.]*$)", r.choice([" dot ", " (dot) ", " [dot] "]), x)
            return x.upper() if r.random() < 0.12 else x
        if kind == "phone":
            a, b, c = str(r.randint(201, 989)), digits(3), digits(4)
            return r.choice(
                [
                    f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"({a}){b} {c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}{b}{c}", f"1-{a}-{b}-{c}",
                    f"+1 {a} {b} {c}", f"+44 20 {digits(4)} {c}", f"+4420{digits(4)}{c}", f"020 {digits(4)} {c}", f"+49 {a} {digits(7)}",
                    f"0{digits(4)} {digits(6)}", f"+33 1 {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"({a}) {b}.{c}"
                ]
            )
        if kind == "phonelike":
            s = r.choice(".- ")
            return f"{r.randint(201, 989)}{s}{digits(3)}{s}{digits(4)}"
        if kind in ("ssn", "ssnlike"):
            s = r.choice(["-", "-", " ", ".", ""]) if kind == "ssn" else "-"
            return f"{digits(3)}{s}{digits(2)}{s}{digits(4)}"
        if kind == "nhs":
            return f"{digits(3)} {digits(3)} {digits(4)}" if r.random() < 0.8 else digits(10)
        if kind.lower() == "place":
            x = r.choice("ward unit hospital clinic wing site home centre practice".split())
            return x.capitalize() if kind == "Place" else x
        if kind == "work":
            return r.choice(
                "farm worker,office worker,retired teacher,young adult,man,woman,boy,girl,cook,driver,nurse,patient,resident,student,gentleman,lady".split(",")
            )
        if kind == "nino":
            return r.choice(["AB {} {} {} C", "QQ{}{}{}B", "JK {} {} {} D"]).format(digits(2), digits(2), digits(2))
        if kind == "pol":
            return r.choice(
                [
                    f"{r.choice('ABHKOPU')}{r.choice('LMNPRX')}-{digits(4)}-{digits(4)}", f"{r.choice('ABCDEF')}{digits(8)}", f"{digits(9)}",
                    f"{r.choice('ABC')}{r.choice('XYZ')}{digits(7)}",
                    f"{r.choice('PQRS')}{r.choice('TVXZ')}-{digits(5)}-{r.choice(['AA', 'B', 'CD'])}"
                ]
            )
        if kind == "short7":
            return f"{digits(3)}-{digits(4)}"
        if kind == "nct":
            return r.choice(["NCT", "NCT", "EUC", "TR"]) + digits(r.choice([8, 9]))
        if kind.startswith("ln"):
            return r.choice("ABCDEFGHKLMNPRSTXYZ") + digits(int(kind[2:]))
        if kind[0] == "n" and kind[1:].isdigit():
            return digits(int(kind[1:]))
        if kind == "d2y":
            return f"{r.randint(0, 21):02d}"
        if kind[0] == "d" and kind[1:].isdigit():
            return str(r.randint(10 ** (int(kind[1:]) - 1), 10 ** int(kind[1:]) - 1))
        if kind == "t":
            return r.choice([f"{r.randint(0, 23)}:{r.randint(10, 59)}", f"{r.randint(0, 23)}.{r.randint(10, 59)}"])
        if kind == "addr":
            name = r.choice(
                [
                    f"{r.randint(1, 120)}{r.choice(['th', 'th', 'nd', 'st', 'rd'])}", self.town(), r.choice(_STREET_A),
                    f"{self.town()} {r.choice(['Park', 'Mill', 'Hill', 'Ferry', 'Chapel', 'Green'])}",
                    f"{r.choice(['Old', 'Upper', 'Lower', 'N.', 'W', 'South', 'East', 'New'])} {self.town()}", self.town()
                ]
            )
            x = f"{r.randint(1, 9900)}{r.choice(['', '', '', 'A', 'B', 'C'])} {name} {r.choice(_KIND)}"
            return x.upper() if r.random() < 0.1 else x.lower() if r.random() < 0.07 else x
        if kind == "town":
            return self.town()
        if kind in ("noun", "Noun"):
            x = r.choice(_NOUN) if r.random() < 0.75 else r.choice(_SYL_A) + r.choice(_SYL_B) + r.choice(
                [
                    "itis", "osis", "aemia", "oma", "opathy", "oscopy", "ectomy", "uria", "algia", "in", "ine", "ide", "ism", "ation", "ness", "ment",
                    "ing"
                ]
            )
            return x.capitalize() if kind == "Noun" else x
        if kind == "N":
            return self.word() if r.random() < 0.8 else r.choice(_LAST)
        if kind == "Dev":
            return r.choice("Lead Wire Axis Port Pin Belt Speed".split())
        x = r.choice(_SYL_A) + r.choice(_SYL_B) + r.choice(_DRUG)
        return x.capitalize() if kind == "Drug" else x

    def inverted(self) -> str:
        x = self.surname()
        return f"{x[0].upper()}{x[1:]}, {self.given()}" + (f" {self.r.choice('ABDEFGHJKLMRST')}." if self.r.random() < 0.2 else "")

    def town(self) -> str:
        return (self.r.choice(_STREET_A) if self.r.random() < 0.4 else self.word(["er", "en", "a", "or", "is"])) + self.r.choice(_STREET_B)


_OF = {"full": "name", "inv": "name", "sur": "name", "email": "email", "phone": "phone", "addr": "address"}


def make(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n labelled texts of one to four sentences in several layouts."""
    maker = _Maker(seed)
    frames = [f for line in FRAMES.strip().split("\n") for f in line.split("|")]
    out = []
    for _ in range(n):
        text, gold = "", []
        for k in range(maker.r.choice([1, 2, 3, 4])):
            if k:
                text += maker.r.choice([" ", " ", "  ", "\n", "\n- ", f",{k}.  ", ",HISTORY:,"])
            elif maker.r.random() < 0.1:
                text += maker.r.choice(["- ", "HISTORY:,", "PLAN  ", "1. "])
            at = 0
            frame = maker.r.choice(frames)
            for m in re.finditer(r"\{(\w+?)(\*?)\}", frame):
                text += frame[at : m.start()]
                value = maker.value(m[1])
                if m[2]:
                    gold.append((len(text), len(text) + len(value), _OF.get(m[1], "id_number")))
                text += value
                at = m.end()
            text += frame[at:]
            if "*" not in frame and maker.r.random() < 0.05:  # a text that stops within its last sentence
                text = text[: len(text) - len(frame) + maker.r.randint(1, 12)] if len(frame) > 14 and "{" not in frame else text
                break
            if "*" not in frame and maker.r.random() < 0.06:
                begin = text.rfind(frame[:1], 0, len(text)) if not k else max(text.rfind("\n"), text.rfind(". "), 0)
                if all(g[1] <= begin for g in gold):  # a shouted line
                    text = text[:begin] + text[begin:].upper()
        out.append((text, gold))
    return out


def main() -> None:
    from .pii_crf import Model, candidates

    train, held = make(SENTENCES, SEED), make(1500, SEED + 1)
    weights = fit(train)
    Path(__file__).with_name("pii_weights.json").write_text(json.dumps(weights, sort_keys=True, ensure_ascii=False, separators=(",\n", ":")))
    model = Model(weights)
    hit = made = gold = reach = 0
    for text, want in held:
        got = set(model.find(text))
        hit, made, gold = hit + len(got & set(want)), made + len(got), gold + len(want)
        reach += len(set(candidates(text)) & set(want))
    print(f"{len(weights)} weights; held out: precision {hit / made:.4f}, recall {hit / gold:.4f}, within candidates {reach / gold:.4f}")


if __name__ == "__main__":
    main()
