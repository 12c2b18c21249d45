"""Forms of lines and titles, cues that make a widely recurring form a message, and placeholders left unfilled."""

from __future__ import annotations

import re

SCRIPT, ERROR, FILLER = 1, 2, 4
# Words of messages, by kind. A cue says nothing by itself: it is asked only of forms that recur across sources where content should be.
SCRIPT_WORDS = frozenset("javascript java-script script scripts scripting skripte noscript browser loading wait moment".split())
ERROR_WORDS = frozenset(
    "error erreur fehler serverfehler err found cannot unavailable gateway denied forbidden unauthorized unauthorised expired timeout timed requests moved deleted removed unpublished broken wrong exception traceback refused unreachable oops whoops hmm wandered nothing"
    " gefunden verfügbar erreichbar verweigert abgelaufen introuvable indisponible n'existe refusé expiré encontrada encontrado disponible existe caducado indisponível negado gevonden beschikbaar geweigerd verlopen checking".split()
)
STAND_INS = frozenset("¶ placeholder goes blindtext platzhalter fülltext relleno remplissage todo tbd tba fixme lorem summary replace construction".split())
TITLE_STAND_INS = STAND_INS | frozenset("sample example dummy new soon".split())
#: Titles that are a printed missing value.
_MISSING = re.compile(r"(?:null|undefined|none|nan|nil|n/?a|\[object object\]|\(null\)|true|false|untitled(?: (?:document|page))?)")
#: Words of the usual filler Latin.
FILLER_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Forms of placeholders left unfilled.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{1,80}\}\}|\{%[^{}\n]{1,80}%\}|<%[^<>\n]{1,80}%>|[$#]\{[^{}\n]{1,60}\}|\$\[[^\[\]\n]{1,60}\]|\$[A-Z][A-Z0-9]*_[A-Z0-9_]+\b|(?<![\w%])%%?[A-Za-z][\w.]{1,40}%%?(?![\w%])"
    r"|@@\w[\w.]{0,40}@@|(?<![\w.])__[A-Z][A-Z0-9_]*__(?!\w)|\(\(\([^()\n]{1,60}\)\)\)|\[\[[^\[\]\n]{1,80}\]\]|<(?:your|insert|enter)[-_ ][\w -]{1,40}>|<[\w]+(?:[-_ ][\w]+)*[-_ ]here>"
    r"|\[(?:YOUR|INSERT|ENTER|ADD|REPLACE|FILL)[ _][^\[\]\n]{1,60}\](?!\()|\[[A-Z][A-Z _]{0,40} HERE\]|\[(?:your|insert|enter) [^\[\]\n]{1,60}\](?!\()"
)
#: What every such form starts with; cheap to look for.
HOLDER_START = re.compile(r"[{%$@_(\[<#](?=[{%$@_(\[\w])")
_MONTHS = r"(?:jan|feb|mar|mär|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez|ene|abr|ago|dic|janv|févr|fév|avr|juin|juil|août|déc|set|out|fev|mrt|mei)[^\W\d_]{0,7}\.?"
_ADDRESS = re.compile(r"\b(?:[a-z][a-z0-9+.-]*://|www\.)[^\s<>()\[\]\"']+|[\w.+-]+@[\w§-]+(?:\.[\w§-]+)+")
_DATE = re.compile(rf"\b0(?:st|nd|rd|th|er|\.|º)?(?: de)? {_MONTHS}(?:,?(?: de)? 0)?\b|\b{_MONTHS} 0(?:st|nd|rd|th)?(?:, ?0)?\b|\b0([-/.])0\1 ?0\b")
_NUMBER = re.compile(r"\d+")
_NEAR_ZERO = re.compile(r"0(?:st|nd|rd|th|er|\.|º)?(?: de)? [^\W\d_]|[^\W\d_]\.? 0|0[-/.]0")  # what every date has
_CODE_SPAN = re.compile(r"``[^\n]*?``|`[^`\n]*`")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|(?<!\w)'[^']*'(?!\w)")
_FILE = re.compile(r"[\w-]+\.[a-z][a-z0-9]{0,4}\W*")
_CODED = re.compile(r"\w*(?:0\w*[a-f]|[a-f]\w*0)\w*")
_MIDDLE = re.compile(r"_(?:\w*_)?")
_EDGES = " \t\"'`*_.,:;!?…()[]-–—"
#: The words titles that are messages consist of; a title with any other word has a subject.
TITLE_WORDS = FILLER_LATIN | frozenset(
    "a an and the this that your you we is are was be been has have to on in of for it not no please try again later sorry continue me my new page site document file content link address title text description body summary paragraph"
    " error erreur fehler http 0 internal server bad gateway timeout timed out service temporarily unavailable access denied forbidden unauthorized unauthorised session expired ended too many requests request moved permanently deleted removed found exist exists available oops whoops something went wrong nothing here yet come back refused connection exception"
    " enable turn activate allow javascript java script scripts scripting browser supported disabled loading redirecting wait just moment one checking run required app"
    " sample example placeholder dummy goes replace insert add todo tbd tba fixme xxx asdf coming soon under construction untitled"
    " seite nicht gefunden verfügbar erreichbar zugriff zugang verweigert abgelaufen sitzung bitte aktivieren sie interner serverfehler warten kanal dienst zurzeit von § page demandée introuvable indisponible la le accès refusé expiré expirée veuillez patienter activer"
    " página pagina no encontrada encontrado disponible existe acceso denegado caducado sesión não encontrada indisponível acesso negado niet gevonden beschikbaar toegang geweigerd verlopen".split()
)
_WORD = re.compile(r"[^\W_]+")
_SITE_NAME = re.compile(r"\s+[|–—·-]\s+[^|–—·]+$")

#: Share of a line's words that must be filler Latin, and least words.
FILLER_SHARE, FILLER_WORDS = 0.8, 6


def masked(line: str) -> str:
    """A line in lower case without its addresses, dates and numbers."""
    s = line.strip().lower()
    if "://" in s or "@" in s or "www." in s:
        s = _ADDRESS.sub("@", s)
    bare = _NUMBER.sub("0", s)
    return _DATE.sub("0", bare) if "0" in bare and _NEAR_ZERO.search(bare) else bare


def form(bare: str) -> str:
    """A masked line without its quotations, paths, file names and code names; filler Latin and repeated words as one sign."""
    if '"' in bare or "'" in bare or "“" in bare or "«" in bare:
        bare = _QUOTED.sub('""', bare)
    if "/" in bare or "_" in bare or "0" in bare or "." in bare[:-1]:
        bare = " ".join([_word_form(w) if "/" in w or "_" in w or "0" in w or "." in w[:-1] else w for w in bare.split()])
    return "¶" if is_filler_latin(bare) or is_repetition(bare) else bare


def _word_form(w: str) -> str:
    if "/" in w[:-1] or _FILE.fullmatch(w):
        return "@"
    if "0" in w:
        w = _CODED.sub("0", w)
    return _MIDDLE.sub(" ", w) if "_" in w else w


def is_filler_latin(line: str) -> bool:
    if not any(w.strip(",.;:") in FILLER_LATIN for w in line[:60].lower().split(None, 3)[:3]):
        return False
    words = _WORD.findall(line.lower())
    return len(words) >= FILLER_WORDS and sum(w in FILLER_LATIN for w in words) >= FILLER_SHARE * len(words)


def is_repetition(bare: str) -> bool:
    """Three words and more, of letters, over and over: at most half of them distinct, and at most four."""
    words = [w for x in bare.split() if (w := x.strip(_EDGES)).isalpha()]
    return len(words) >= 3 and len(set(words)) <= min(4, len(words) // 2)


def cue(bare: str) -> int:
    """SCRIPT, ERROR and FILLER bits of the cues in a form."""
    words = {w.strip(_EDGES) for w in bare.split()}
    return SCRIPT * (not words.isdisjoint(SCRIPT_WORDS)) | ERROR * (not words.isdisjoint(ERROR_WORDS)) | FILLER * (not words.isdisjoint(STAND_INS))


def has_placeholder(text: str) -> bool:
    return HOLDER_START.search(text) is not None and PLACEHOLDER.search(text) is not None and PLACEHOLDER.search(_CODE_SPAN.sub(" ", text)) is not None


def title_forms(title: str, brand: str) -> list[str]:
    """The forms of a title that are counted: whole, and without a site's name at its end."""
    bare = title.strip().lower()
    short = _SITE_NAME.sub("", bare)
    out = []
    for t in dict.fromkeys((bare, short)):
        if brand and brand in t:
            t = re.sub(rf"(?<!\w){re.escape(brand)}(?!\w)", "§", t)
        t = form(masked(t)).strip(" \t\r-*#_.!…:;")
        if t:
            out.append(t)
    return out


def is_message_title(bare: str) -> bool:
    """A title's form that has a cue and no word but those of messages."""
    words = {w.strip(_EDGES) for w in bare.split()}
    return (cue(bare) > 0 or not words.isdisjoint(TITLE_STAND_INS)) and all(w in TITLE_WORDS for w in re.findall(r"[^\W_]+|§", bare))


def is_missing_value(title: str) -> bool:
    return _MISSING.fullmatch(title.strip().lower()) is not None
