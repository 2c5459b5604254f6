"""A grammar of declining answers: words become categories, and patterns over categories say what a clause does.

A clause declines if someone who answers (SELF) is denied or refuses (NOT, REFUSE) an act of answering (TELL), in any
order within a few words, or if questions or answers are said not to be dealt with, to be against rules, or to be for a
professional. It must hold hardly any word that is neither a category's, nor a function word, nor the query's: else it
tells something. An answer is a refusal if a clause declines and every other one declines or is courtesy.
"""

from __future__ import annotations

import re

from .languages import FUNCTION_WORDS

# The words of each category, in English and six other languages.
SELF = """i me my myself we us our ourselves ich mir mich wir uns je j moi nous yo me nosotros io mi noi eu nós ik mij wij we ons
puedo podemos posso possiamo quiero debo podría preferisco prefiero prefiro estoy estamos estou estamos"""
SELF_NOUN = "assistant service system tool model bot chatbot ai program assistent dienst service assistent asistente servicio assistente servizio assistente serviço"
NOT = """not no never nothing none neither nor without nicht nichts kein keine keinen keiner ne n pas aucun aucune rien
non nessun nessuna niente nunca nada ningún ninguna ninguno não nenhum nenhuma niet geen niets"""
BLOCK = "prevent prevents prevented forbid forbids prohibits prohibit keep keeps stop stops bar bars allow let verbieten interdisent impiden impediscono impedem"
REFUSE = """decline declines declining refuse refuses refusing refrain abstain unable unwilling rather prefer reluctant forbidden impossible
ablehnen lehne verweigere verboten untersagt unmöglich refuse refuser interdit impossible incapable rechazo niego imposible prohibido
rifiuto rifiutare impossibile vietato recuso impossível proibido weiger onmogelijk"""
TELL = """answer answering answers reply replying replies respond responding comment commenting discuss discussing discussion help helping
assist assisting assistance say saying speak speaking talk talking engage engaging elaborate weigh opine continue comply going
antworten antworte beantworten beantworte helfen helfe weiterhelfen sagen sage besprechen äußern beraten eingehen
répondre réponds répond aider dire commenter traiter traite traitons aborder discuter parler conseiller
responder respondo contestar contesto ayudar ayudo decir comentar opinar hablar tratar atender aconsejar
rispondere rispondo aiutare dire commentare parlare trattare consigliare
responder ajudar dizer comentar falar tratar aconselhar antwoorden beantwoorden helpen zeggen bespreken adviseren ingaan"""
JUDGE = "advise advising recommend recommending suggest suggesting tell telling know"  # answering only without an object of their own
GIVE = """give giving gives provide providing provides offer offering offers share sharing supply make making do doing handle handling
address addressing cover covering deal dealing fulfil fulfill support geben gebe erteilen machen donner donne fournir fournit dar doy da ofrecer dare fornire dar fornecer geven"""
TOLD = """advice answer answers opinion opinions guidance information recommendation recommendations response reply view views detail details
auskunft auskünfte antwort antworten rat ratschläge ratschlag conseil conseils réponse réponses avis respuesta respuestas consejo consejos
orientación opinión risposta risposte consiglio consigli opinione resposta conselho conselhos antwoord advies"""
TOPIC = """question questions request requests topic topics subject subjects query queries inquiry enquiry frage fragen thema themen anfrage
anfragen question questions demande demandes sujet sujets pregunta preguntas tema temas consulta consultas asunto domanda domande argomento
richiesta pergunta perguntas assunto vraag vragen onderwerp"""
THIS = """matter matters issue issues kind kinds sort sorts type types thing things area art genre this that it such these those one anything something whatever dazu darauf das dies diese dieser diesem solche cela ceci ça ce cette cet
esto eso esa ese esta questo questa ciò isto isso essa esse dit dat deze daar hierop"""
OUTSIDE = "outside beyond against breach violate violates violating breaks break exceeds exceed gegen außerhalb contre hors contra fuera contro fuori fora tegen buiten"
POLICY = """rules rule guidelines guideline policy policies scope remit terms instructions purpose competence regeln richtlinien règles directives
reglas normas regole norme regras diretrizes regels richtlijnen"""
ABLE = """right proper appropriate allowed permitted able comfortable qualified position authorised authorized possible möglich erlaubt
autorisé autorisée autorizado autorizada autorizados posible possibile possível mogelijk"""
DEALT = """answered handled covered discussed supported dealt addressed given provided offered made commented beantwortet behandelt besprochen
gegeben erteilt traitée traitées traité donnée fournie atendida atendidas respondida respondidas trattata trattate fornita respondida tratada beantwoord behandeld"""
OTHER = "another other else different more further anderes andere autre otro otra altro altra outro outra ander"
DEFER = "best better safer wiser leave left matter something refer belongs besten besser lieber mieux meilleur mejor meglio melhor beter"
EXPERT = """doctor doctors clinician clinicians physician physicians professional professionals pharmacist pharmacists nurse specialist specialists
expert experts team practice gp provider prescriber arzt ärztin apotheker apothekerin praxis fachmann médecin pharmacien soignant professionnel
médico médica farmacéutico doctor medico farmacista dottore médico farmacêutico arts apotheker huisarts"""
CONSULT = """ask speak talk see consult contact turn check get reach refer discuss call visit take raise put go seek wenden fragen fragen
sprechen voyez voir consultez demandez parlez adressez consulte pregunte hable acuda diríjase vea chieda consulti parli fale procure pergunte consulte raadpleeg vraag"""
COURTESY = """sorry apologies apologise apologize unfortunately regrettably regret afraid pardon thank thanks please kindly glad happy welcome
hope understand appreciate feel free love like wish leid bedauere bedaure leider danke bitte désolé désolée regrette malheureusement merci veuillez
siento lamento disculpe desafortunadamente gracias favor mi dispiace spiacente purtroppo grazie prego desculpe infelizmente obrigado obrigada
spijt helaas bedankt tut es change pick choose let"""
PASSIVE = "se si"
SOMEONE = "you he she they patient patients people children adults women men anyone person persons"

_TAGS = {
    "C": COURTESY, "L": DEFER, "E": OTHER, "D": THIS, "O": OUTSIDE, "P": POLICY, "Y": DEALT, "T": TOPIC, "V": CONSULT, "G": GIVE, "I": TOLD, "J": JUDGE,
    "A": TELL, "K": EXPERT, "U": PASSIVE, "H": SOMEONE, "W": ABLE, "B": BLOCK, "R": REFUSE, "S": SELF, "N": NOT,
}
#: Every category of a word; most words have one.
_OF: dict[str, str] = {}
for _tag, _list in _TAGS.items():
    for _word in dict.fromkeys(_list.split()):
        _OF[_word] = _OF.get(_word, "") + _tag
_SELF_NOUN = frozenset(SELF_NOUN.split())
_BEFORE_NOUN = frozenset(
    "this the a an our ai language digital virtual automated medical health dieser der ein ce cet un este el questo il este o deze de".split()
)
_FUNCTION = frozenset(w for words in FUNCTION_WORDS.values() for w in words) | frozenset(
    "a an am i'm m s t ve d ll re us let here there some any enough too so up out into reasons safety medical health care own would will could go goes cannot".split()
)
_COMPLEMENT = frozenset("whether if how what why when which that".split())
_PLAIN_AFTER = frozenset("on about you regarding in here for with further and or".split())

def _grammar(pattern: str) -> re.Pattern:
    """A pattern over categories (one letter each, _ for any few words) as one over the written categories of a clause."""
    return re.compile(
        re.sub(
            r"\[([A-Z]+)\]|([A-Z])", lambda m: f"(?:[^ ]*[{m[1] or m[2]}][^ ]* )", pattern
        ).replace("_", "(?:[^ ]+ ){0,6}?").replace("-", "(?:[^ ]+ ){0,3}?")
    )


#: Patterns over categories; _ are up to six words of any kind, - up to three. SELF may stand before or after the negation; the act comes after both, apart from a few words.
_DECLINES = [_grammar(p) for p in (
    "S_[NR]_(?:A|G-[ITD])", "[NR]_S_(?:A|G-[ITD])", "S_[NR]G?$", "N-SF?$", "P_B_[SA]", "[AIT]_O_P", "O-S-P", "N-I_Y", "T_N-[YA]", "[AI]_N-[YW]",
    "N-U-G-I", "R-A", "VD-K", "S_[NR]_T", "O-S_A", "T_[AY]-K", "S_R_K", "S_N-I", "N-W-A", "D_L_K", "L_L_K", "T_A-K", "A-E-T", "C-E-T", "C-A-E-T",
)]
_CONSULTS = [_grammar(p) for p in ("V_K", "K_[AC]", "K_V")]

_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_SPLIT = re.compile(r"(?<=[.!?;。！？])\s+|(?<=[。！？])|\n+")
#: Where a sentence turns to something else, and an opening whose main clause says what matters.
_TURN = re.compile(r",?\s+but\b,?\s+|,\s+however\b,?\s+|,\s+(?:aber|pero|mais|ma|maar|mas|но|и|а)\s+|\s*[;:]\s*", re.I)
_CONCESSION = re.compile(r"^(?:while|whilst|although|though|even though)\b[^,]*,\s*", re.I)
_CONTRACTED = re.compile(r"\b([a-z]+)n't\b")
_WHOLE = {"ca": "can", "wo": "will", "sha": "shall"}
#: Declining in languages whose words the categories don't have (fixed patterns).
_ELSEWHERE = re.compile(r"не могу|не можем|отказываюсь|невозможно ответить|无法|不能|不便|抱歉.{0,12}(?:不|无)|申し訳|お答えできません|できません|답변할 수 없|없습니다")


def categories(clause: str, known: frozenset) -> list[str]:
    """The categories of each word of a clause; Q for words of the query, F for function words, X for any other."""
    x = clause.lower().replace("’", "'").replace("cannot", "can not")
    words = _TOKEN.findall(_CONTRACTED.sub(lambda m: f"{_WHOLE.get(m[1], m[1])} not", x))
    out = []
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else ""
        tags = _OF.get(w, "")
        if "J" in tags:  # "I can't advise on this", but not "I don't recommend aspirin" nor "I can't say whether"
            tags = "J" + ("A" if not after or after in _PLAIN_AFTER or after in _OF and set("DT") & set(_OF[after]) else "")
        if "A" in tags and after in _COMPLEMENT and (after != "that" or w in ("say", "saying") and i + 2 < len(words)):
            tags = "J"
        if w in _SELF_NOUN and i and words[i - 1] in _BEFORE_NOUN:
            tags += "S"
        if not tags:
            tags = "F" if w in _FUNCTION else "Q" if w in known else "X"
        out.append(tags)
    return out


def declines(tags: list[str]) -> bool:
    """Whether a clause, given as categories(), declines to answer and tells nothing else."""
    if sum(t == "X" for t in tags) > max(2, 0.34 * len(tags)):
        return False
    line = " ".join(tags) + " "
    if "S" not in line and "H" in line:
        return False  # about someone else
    return any(p.search(line) for p in _DECLINES)


def courteous(tags: list[str]) -> bool:
    """Whether a clause only apologises, thanks, offers or sends to a professional."""
    other = sum(t in "QX" for t in tags)
    if other > 2:
        return False
    line = " ".join(tags) + " "
    return other <= 1 and any("C" in t for t in tags) or all(t in ("F", "H") or set(t) & set("SEDACLN") for t in tags) or any(p.search(line) for p in _CONSULTS)


def _sentences(text: str):
    """Sentences one by one; most answers are told by their first."""
    at = 0
    for m in _SPLIT.finditer(text):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


def is_refusal(answer: str, query: str = "") -> bool:
    """Whether a clause of the answer declines and no other one tells anything. The answer is read whole."""
    known = frozenset(_TOKEN.findall(query.lower()))
    refused = False
    for s in filter(None, (s.strip(" \t\r\n\"*_-") for s in _sentences(answer))):
        s = s.rstrip(".!?;… ")
        if m := _CONCESSION.match(s):
            s = s[m.end() :]
        for clause in filter(None, (c.strip(" ,;") for c in _TURN.split(s))):
            if not clause.isascii() and _ELSEWHERE.search(clause):
                refused = True
                continue
            tags = categories(clause, known)
            if not tags:
                continue
            if declines(tags):
                refused = True
            elif not courteous(tags):
                return False
    return refused
