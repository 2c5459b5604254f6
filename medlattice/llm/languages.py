"""Which language a text is in: by script where that tells, else by the function words of languages in Latin script."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "a an i my we will its t the of and to in is are was be been for with that this it on as by at from or not can may should have has were which who how what why when does do after before if but their there these your you he she they than then about".split(),
    "de": "der die das und ist in den von zu mit sich auf für nicht ein eine einer eines dem des im wird werden bei nach über oder auch als aus kann sollte wenn dass durch es sind war hat haben wie was warum pro vor ohne ihre ihren sie man darf nur".split(),
    "fr": "le la les de des du et est en un une dans pour que qui ne pas par sur avec au aux ce cette sont il elle ou plus se sa son ses leur peut être quand chez pendant sans avant après quels quelle quel comment pourquoi doit il faut l d qu n s".split(),
    "es": "el la los las de del y es en un una que por con para no se su sus al lo como más o son está puede ser si cuando durante sin antes después debe cuál qué cómo desde hasta muy también este esta".split(),
    "it": "il lo la i gli le di del della dei delle e è in un una che per con non si su al alla come più o sono può essere se quando durante senza prima dopo deve quale cosa dal dalla nel nella anche questo questa".split(),
    "pt": "o a os as de do da dos das e é em um uma que por com para não se seu sua ao à no na como mais ou são pode ser quando durante sem antes depois deve qual quais pelo pela também este esta".split(),
    "nl": "de het een en van is in op te dat die voor met niet aan er om bij als zijn door naar ook uit of wordt kan moet na over deze worden heeft geen wat hoe waarom per zonder".split(),
    "sv": "och att det som en ett är av för på med den till inte har de om kan ska efter vid eller från när man var hur vad också utan före mycket mer bör blir".split(),
    "da": "og at det som en et er af for på med den til ikke har de om kan skal efter ved eller fra når man var hvordan hvad også uden før meget mere bør bliver".split(),
    "no": "og at det som en et er av for på med den til ikke har de om kan skal etter ved eller fra når man var hvordan hva også uten før mye mer bør blir".split(),
    "fi": "ja on ei että se tai kun ovat voi joka mutta myös kuin jos sen olla ole niin hän mikä miten ennen jälkeen ilman pitää tulee sekä kanssa".split(),
    "pl": "i w na z się nie do że jest to od dla po przez jak lub oraz są może przed bez być które który przy pod jego ale także gdy czy co należy nad tym".split(),
    "cs": "a v na se je že s z do o to pro nebo po od by jako při jsou není před bez může být které který také ale když jak co má až podle lze".split(),
    "hu": "a az és hogy nem is egy van vagy meg kell mint de ha már csak lehet után előtt nélkül által ez azt mely minden naponta akkor mi miért hogyan".split(),
    "ro": "și de la în nu cu pe este se din care pentru sau mai să ce sunt poate după prin fără înainte dacă fi când cum trebuie ale unui unei acest această".split(),
    "tr": "ve bir bu için ile da de olarak daha çok gibi en ise veya sonra önce kadar değil var olan her ne nasıl neden ama tarafından göre günde olabilir ancak".split(),
    "id": "dan yang di dari untuk dengan pada ini itu tidak atau dalam adalah ke oleh akan dapat setelah sebelum bisa juga harus karena lebih jika apa bagaimana mengapa tanpa sudah anda".split(),
    "vi": "và của là có không được cho các trong với một người này khi những đã để từ hoặc sau trước thể như bị nên cần nếu thì bạn".split(),
    "hr": "i u je na se da za od su ne s kao koji koja što ili nije biti može prije nakon bez kod ako te ali kako zašto treba također ovaj".split(),
    "sw": "na ya wa kwa ni za katika la kuwa cha hii kama au baada kabla si pia hadi kila wakati lakini watu ili bila".split(),
    "ca": "el la els les de del i és en un una que per amb no es al com més o són està pot ser si quan durant sense abans després ha dels amb aquest aquesta també".split(),
}

LANGUAGES_OF: dict[str, tuple[str, ...]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in _words:
        _bare = "".join(c for c in unicodedata.normalize("NFD", _w) if not unicodedata.combining(c))
        for _x in {_w, _bare} if len(_bare) > 2 else {_w}:
            LANGUAGES_OF[_x] = tuple(dict.fromkeys((*LANGUAGES_OF.get(_x, ()), _lang)))
#: Every function word of any language.
ANY_FUNCTION_WORD = frozenset(LANGUAGES_OF)

_SCRIPT = re.compile(
    r"(?P<latin>[A-Za-zÀ-ɏḀ-ỿ])|(?P<cyrillic>[Ѐ-ӿ])|(?P<greek>[Ͱ-Ͽ])|(?P<arabic>[؀-ۿ])|(?P<hebrew>[֐-׿])|(?P<devanagari>[ऀ-ॿ])|(?P<thai>[฀-๿])|(?P<kana>[぀-ヿ])|(?P<hangul>[가-힯])|(?P<han>[㐀-鿿])"
)
_NOT_LATIN = re.compile(r"[Ͱ-῿぀-힯]")
_LETTERS = re.compile(r"[^\W\d_]+")


def script(x: str) -> str:
    """The script of at least a third of the letters, Han counted twice, if it is not Latin; else 'latin', or '' without letters."""
    if not _NOT_LATIN.search(x):
        return "latin" if _LETTERS.search(x) else ""
    counts: dict[str, int] = {}
    for m in _SCRIPT.finditer(x):
        counts[m.lastgroup] = counts.get(m.lastgroup, 0) + (2 if m.lastgroup == "han" else 1)
    if not counts:
        return ""
    main = max(counts, key=lambda n: counts[n])
    return main if main != "latin" and counts[main] >= 0.35 * sum(counts.values()) else "latin"


def letters(x: str) -> list[str]:
    """Runs of letters of a text, in lower case."""
    return _LETTERS.findall(x.lower())


def scores(words: list[str]) -> tuple[dict[str, float], int]:
    """(share of function words of each language, words shared by several divided among them; number of function words)."""
    found = Counter(map(LANGUAGES_OF.get, words))
    found.pop(None, None)
    hits = found.total()
    score: dict[str, float] = {}
    for langs, n in found.items():
        for name in langs:
            score[name] = score.get(name, 0.0) + n / len(langs) / hits
    return score, hits
