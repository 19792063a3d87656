"""Machine output gone wrong: unfilled template fields, filler text, error pages and notices that scripts are needed.

A record is cut into messages, its lines and sentences. A message is masked (tags, fields, links, numbers) and goes down a
prefix tree of fixed depth: by its number of tokens, then by its first ``DEPTH`` tokens, to a leaf. A leaf is split further
by the *telling* tokens of its messages, those that a verdict may rest on; members agree in all of them at the same places,
so that no message can blur the template of another, whatever else shares its leaf. The path, the telling tokens and ``<*>``
elsewhere are the template. This split needs no running order, and so gives the same templates however rows are spread.

Templates, not messages, are classified, each once: what a page or program says of itself is scored by the kinds of thing it
says (a fault, a status or code, the part of a site it concerns, a remedy offered) against signs that a person talks (pronouns
of people, story-telling, words that belong to neither). A template just below the mark passes if it is met again and again.
Verdicts go back to the messages by a join that cannot meet a hot key. Fields that were never filled are found apart, as they
turn up in ordinary messages whose template says nothing.

Rows without any telling word, nearly all, are left out by one linear scan of each column batch and never looked at in Python.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.relational import skew_join
from loomline.session import cut_lineage

DEPTH = 4
#: Share of a record's words that must be machine messages for it to *be* an error page, a notice or filler.
MOST = 0.6
#: Score from which a template is a machine's, and how far below it one may lie that was met in ``AGAIN`` messages.
LEAST, NEAR, AGAIN = 0.9, 0.3, 5

# --- fixed values: fields ------------------------------------------------------------------------------------------
# Names that forms and bots give their fields.
FIELDS = (
    "name first_name last_name full_name user username author title thread_title topic subject body text message reason date time year "
    "city country company product item count number url link id post_id headline summary description email price amount field value"
).replace(" ", "|")
# Spellings of an unfilled field.
SLOT = "|".join(
    (
        r"\{\{[^{}\n]{1,40}\}\}",
        r"[$#]\{[\w. ]{1,40}\}",
        r"<%=?[^%\n]{1,40}%>",
        r"\*\|[\w ]{1,40}\|\*",
        r"@@\w{1,40}@@",
        r"\[\[[\w ]{1,40}\]\]",
        r"%\(\w{1,40}\)s",
        rf"(?i:%(?:{FIELDS})%)",
        r"%[A-Z][A-Z_]{2,40}%",
        r"<<[\w ]{1,40}>>",
        r"\{[A-Za-z_]\w{0,30}(?: \w{1,30}){0,3}\}",
        r"\{\d{1,2}\}",
        r"(?i:\[(?:insert|your|enter) [^\]\n]{1,40}\])",
        r"\[[A-Z]{2,20}(?:_[A-Z]{2,20})+\]",
        rf"(?i:__(?:{FIELDS})__)",
        r"(?i:\[object object\])",
    )
)

# --- fixed values: vocabulary of sites and programs, in English, German, French and Spanish -----------------------
_VERB = "reach|connect|load|open|find|found|process|complete|establish|display|resolve|serve|read|retrieve|access|verify|locate|handle|fulfil|parse|write"
FAULT = "|".join(
    (
        r"not (?:be )?found|(?:does not|doesn't|no longer|don't) exists?|un ?available|(?:not|no longer) available|(?:access|permission) (?:is |was |to \S+ )?denied|forbidden",
        r"expired|timed? ?out|timeout|bad (?:gateway|request)|too many (?:requests|connections|redirects|attempts)|rate[- ]?limit(?:ed)?|(?:quota|limit) exceeded",
        rf"(?:can't|can’t|cannot|can not|could not|couldn't|unable to|failed to|fails to|did not|not) (?:be )?(?:{_VERB})(?:e?d)?",
        r"(?:internal|unexpected|unknown|fatal|server|application|database|syntax|parse|critical|system|connect(?:ion)?|network|runtime|http|configuration|script) (?:\w+ )?error(?: (?:has |have )?(?:been )?(?:occurr?ed|encountered))?|error (?:establishing|loading|connecting|opening|reading|processing|parsing|fetching|while|page)",
        r"(?:something|things?) went wrong|errors? (?:has |have )?(?:been )?(?:occurr?ed|encountered)|encountered an? (?:\w+ )?(?:error|problem|exception)",
        r"(?:connection|request|login|upload|verification|operation|authentication|handshake|query|download) (?:was |has been |has )?(?:refused|reset|closed|failed|aborted|blocked|rejected|interrupted|lost|cancell?ed|rate limited)",
        r"too long to respond|not respond(?:ing)?|(?:down|closed|undergoing|scheduled|under|offline) (?:for )?(?:scheduled |planned |routine |emergency )?maintenance|under construction",
        r"over(?:loaded| capacity| quota)|(?:do not|don't|don’t|not) have (?:\w+ )?(?:permission|access|authorization)|not (?:authori[sz]ed|permitted|allowed)|unauthori[sz]ed|mistyped|method not allowed",
        r"invalid (?:request|token|url|session|parameter|argument|credentials|characters?|hostname)|unhandled exception|uncaught|segmentation fault|core dumped|null pointer",
        r"(?:prove|verify|confirm|check)(?:ing)? (?:that |if )?you are (?:a |not a )?(?:human|robot)|are you (?:a )?(?:human|robot)|unusual (?:traffic|activity)|(?:temporarily|currently) (?:down|offline|disabled|suspended)",
        r"has been (?:suspended|blocked|disabled|terminated)|will be back|offline|certificate (?:is |has )?(?:not valid|invalid|expired)|not (?:secure|trusted)|went offline|out of memory|not load|quota exceeded",
        r"nicht (?:\w+ )?(?:gefunden|verfügbar|vorhanden|erreichbar|geladen|möglich)|abgelaufen|zugriff verweigert|fehlgeschlagen|wartungsarbeiten|(?:interner|unerwarteter|ein) (?:\w+ )?fehler(?: ist)?(?: aufgetreten)?|\w*serverfehler|überlastet|existiert nicht|keine berechtigung",
        r"introuvable|indisponible|n['’]existe (?:pas|plus)|accès (?:refusé|interdit)|expirée?|a échoué|en (?:cours de )?maintenance|(?:une )?erreur (?:\w+ )?(?:s['’]est produite|est survenue)|erreur(?= (?:interne|inattendue|serveur|:))|n['’]avez pas (?:la permission|l['’]autorisation|accès)|a été (?:déplacée?|supprimée?)",
        r"no (?:se )?(?:ha |pudo |puede )?(?:sido )?(?:encontrad[oa]|encontró|encontrar)|no (?:está |se encuentra )?disponible|no existe|acceso (?:denegado|prohibido)|expirado|caducado|en mantenimiento|(?:ha ocurrido|se ha producido|se produjo)(?: un)?(?: error)?(?: inesperado| interno)?|error (?:interno|inesperado)|no tiene (?:permiso|autorización|acceso)",
    )
)
_STATUS = (
    r"(?:ok|moved permanently|not found|bad gateway|forbidden|gone|gateway time-?out|service unavailable|internal server error|too many requests|bad request|"
    r"unauthori[sz]ed|request time-?out|service temporarily unavailable|method not allowed|conflict|payload too large|not implemented)"
)
CODE = "|".join(
    (
        rf"<n>:? (?:- )?{_STATUS}|{_STATUS} \(?<n>",
        r"(?:http|https)(?:/\S+)? (?:error |status )?<n>|error:? (?:code:? )?<n>|(?:code|status|errno):? <n>|error code",
        r"[\"'](?:error|errors|status|code|message|detail)[\"'] ?:",
        r"[\w.]*\w(?:error|exception)(?= ?:|$| at )|traceback \(most recent call last\)|stack ?trace|line <n>|at \S+\(\S*\)|\w+\(\):|err_\w+|e[a-z]{5,}:|panic:|fatal:|file [\"']\S+[\"'],",
        r"\b<n>x<n>\b|0x<n>",
    )
)
THING = (
    r"(?:web)?(?:page|site|server)s?|service|request(?:ed)?|urls?|address|resource|files?|content|connection|session|gateway|database|browser|host|domain|network|link|"
    r"application|app|system|token|cookies?|proxy|upstream|headers?|javascript|settings|permission|account|password|captcha|end|"
    r"(?:web)?seiten?|adresse|dienst|anfrage|verbindung|sitzung|datei|inhalte?|datenbank|serveur|requête|connexion|contenu|ressource|fichier|navigateur|"
    r"páginas?|servidor|sitio|dirección|servicio|solicitud|conexión|sesión|contenido|recurso|navegador"
)
REMEDY = (
    r"please|try again|tr(?:y|ied) (?:to )?(?:re)?load(?:ing)?|reload|refresh(?:ing)?|go back|return to|contact (?:the |your |us\b|support)(?:\w+)?|(?:log|sign) in|be back|later|shortly|a moment|(?:a )?few (?:minutes|moments)|"
    r"check(?: the| your|ing)?|seconds?|minutes?|apologi[sz]e|sorry|oops|thank you|patience|proceed(?:ing)?|continue|inconvenience|complete|below|administrator|webmaster|working on|"
    r"bitte|versuchen|später|erneut|zurück|veuillez|réessaye[rz]|plus tard|merci|désolée?s?|por favor|inténtelo|intente|más tarde|vuelva|lo sentimos|disculpe"
)
#: What stands around the message on a page, or after it in a bot's post.
AROUND = (
    r"home|forums?|archive|log ?in|login|log ?out|sign ?(?:in|up|out)|register|help|contact|about|privacy|terms|policy|skip to|menu|search|copyright|all rights reserved|©|loading|back|top|next|previous|"
    r"powered by|reference|ray|id|incident|ip|i am a bot|this action was performed automatically|beep boop|must be enabled|enabled|with questions|toggle|navigation|subscribe|newsletter|share|print|security|protect(?:ed|s)?|[|^»·-]|<n>|<url>|<slot>"
)
#: Signs that a person talks.
PERSON = (
    r"i(?!\s+am a bot)(?:['’](?:m|ve|d|ll))?|my|me|mine|myself|he|she|his|her|him|they(?:['’]\w+)?|their|them|anyone|anybody|somebody|someone|everyone|everybody|nobody|who|whoever|why|"
    r"said|says|say|told|asked|called|people|guys?|lol|lmao|yesterday|honestly|funny|ich|mein\w*|mir|je|j['’]ai|moi|yo|ellos|alguien|jemand|quelqu['’]un|mon|mes|mi|mis"
)
STORY = (
    r"then|because|so(?= (?:i|we|you|that|of)\b)|since|ago|before you|came|got|went(?! wrong| offline)|took(?! too long)|like that|what the|that is how|reads? like|looks? like(?! (?:you|your|we|the|javascript|something)\b)|week|weeks|night|"
    r"finally|anymore|again and again|exactly when|sounds?|basically|literally|actually"
)
_SCRIPT = r"java ?-?scripts?|js|scripts?|skripte?"
NEEDED = (
    r"(?:re-?)?enabled?|enabling|activer|activar|activez|aktivieren|aktiviert|turn(?:ed)? (?:it )?(?:on|off)|switch(?:ed)? (?:on|off)|allow(?:ed)?|requires?|required|disabled|blocked|necessary|does not support|turned off|nécessaire|nécessite|necesario|"
    r"requiere|benötigt|habilit\w+"
)
STAND_IN = r"placeholders?|sample|dummy|filler|example|test|testing|lorem ipsum|blindtext|platzhalter(?:text)?|mustertext|beispieltext|exemple|ejemplo|relleno|muestra|tbd|todo|tba|boilerplate|your own|faux texte"
TEXT_THING = (
    r"text|paragraph|content|copy|comment|body|title|headline|description|caption|page|article|layout|texte|contenu|texto|contenido|inhalt|titel|titre|título|párrafo|form|post|"
    r"lorem ipsum|blindtext|platzhaltertext|mustertext|beispieltext|faux texte|página"
)
#: What filler says of itself by the verb alone, and what it says besides.
STRONG = (
    r"go(?:es)? here|to be (?:supplied|added|replaced|announced|written|determined|completed)|for (?:layout|demonstration|illustration|display)(?: purposes)?|do not publish|please ignore|"
    r"(?:insert|type|enter|add|write|put) (?:\w+ ){0,2}(?:text|content|title|name|comment|description) here|à (?:remplacer|compléter)|aquí va|steht (?:später|hier)|wird (?:später|noch)|kommt noch"
)
INSTRUCT = rf"{STRONG}|replace|coming soon|for testing|insert|hier|ici|publish(?:ing)?"
# Words of the standard filler passage and of the text it was taken from.
LATIN = (
    "lorem ipsum dolor dolore dolorem sit amet consectetur consectetuer adipiscing adipisicing adipisci elit sed eiusmod tempor tempora incididunt ut labore magna magnam "
    "aliqua aliquam enim minim veniam quis nostrud nostrum exercitation exercitationem ullamco ullam corporis laboris laborum nisi aliquip aliquid ex ea commodo commodi "
    "consequat consequatur duis aute irure reprehenderit voluptate voluptas voluptatem velit esse cillum fugiat nulla pariatur excepteur sint occaecat occaecati cupidatat non "
    "proident culpa officia deserunt mollit anim animi est et perspiciatis unde omnis iste natus error accusantium doloremque laudantium totam rem aperiam eaque ipsa quae "
    "inventore veritatis quasi architecto beatae vitae dicta explicabo nemo ipsam quia aspernatur odit aut fugit consequuntur magni magnis dolores eos ratione sequi nesciunt neque porro "
    "quisquam numquam eius modi quaerat suscipit laboriosam vel eum iure quam nihil molestiae illum qui quo"
).split()
_LATIN = frozenset(LATIN)
#: Little words of the living languages; filler text has none.
LITTLE = frozenset("the of and to in is that it was for on with as at by this be from der die das und ist nicht ein eine zu mit le la les des est une et pas el los las que y es por con un de du en il a an you your our will it its we are has have been or not an sie um".split())
_ENDING = re.compile(r"(?:or|um|em|us|is|it|et|am|at|ra|ua|ia|ta|ma|sa|da|te|os|as|es|ent|unt|ae|re|ne|im)$")

_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def _walks(n: int) -> str:
    """Runs of ``n`` neighbouring keys, either way."""
    return "|".join(r[i : i + n] for row in _ROWS for r in (row, row[::-1]) for i in range(len(r) - n + 1))


MASH = re.compile(rf"(?:{_walks(4)}|{_walks(3)})+")


def _word(p: str) -> re.Pattern[str]:
    return re.compile(rf"(?<![\w<])(?:{p})(?![\w>])")


_KINDS = {"fault": FAULT, "code": CODE, "thing": THING, "remedy": REMEDY, "person": PERSON, "story": STORY, "script": _SCRIPT, "needed": NEEDED, "stand_in": STAND_IN, "text_thing": TEXT_THING, "instruct": INSTRUCT, "strong": STRONG}
_FORMS = {k: _word(p) for k, p in _KINDS.items()} | {"code": re.compile(CODE)}
_AROUND = re.compile(rf"(?<!\w)(?:{AROUND})(?!\w)")
_SLOT = re.compile(SLOT)
_QUOTED_SLOT = re.compile(rf"[\"“„'`][^\"”“'`\n]{{0,60}}(?:{SLOT})[^\"”“'`\n]{{0,60}}[\"”“'`]")
# Words of those who write about templates.
_META = re.compile(r"(?i)\b(?:code|template|syntax|placeholders?|printf|format string|variables?|user input|arguments?|escap\w+|regex|exploit|typo|quote[ds]?|replace\s+(?:\S+\s+)?with)\b")
_TALK = re.compile(r"(?i)\b(?:my|me|he|she|his|her|they|their|them|who|somebody|anybody|these|those|i(?! am a bot))\b(?!['’])")
_CUT = re.compile(r"[\r\n]+|(?<=[.!?…])\s+")
_TAG = re.compile(r"</?(?:html|head|title|body|center|h[1-6]|hr|br|p|div|span|noscript|pre|b|i|a|ul|li|meta|!doctype)\b[^>]*>", re.I)
_URL = re.compile(r"https?://\S+")
_NUMBER = re.compile(r"(?<![\w<])(?=[0-9a-f]*\d)[0-9a-f]+(?![\w>])")
_LETTERS = re.compile(r"[^\W\d_]+")

_SPACE = r"(?:(?:\s|&nbsp;)+)"
_AHEAD = re.compile(r"\(\?[=!](?:[^()]|\([^()]*\))*\)")


def _gate() -> str:
    """What a message must hold to get a verdict, and a row to be looked at, for a linear matcher over lower-cased texts."""
    code = (
        rf"\d\w*:? (?:- )?{_STATUS}|{_STATUS} \(?\d|http(?:s|/\S+)? (?:error |status )?\d|error:? (?:code:? )?\d|error code|\w(?:error|exception)\b|traceback|stack ?trace|line \d|\w\(\):|err_|"
        r"(?:code|status|errno):? \d|[\"'](?:errors?|status|code|message|detail)[\"'] ?:|\be[a-z]{5,}:|panic:|fatal:|\b0x|\bat \S+\(\S*\)|file [\"']"
    )
    again = "|".join(f"{w} {w} {w}" for w in sorted({"blah", *re.findall(r"[a-z]+", TEXT_THING + STAND_IN)}) if len(w) > 2)
    filler = rf"\b(?:{'|'.join(w for w in LATIN if len(w) > 4 and w not in ('error', 'ratione', 'minim', 'culpa', 'dicta'))})\b|{_walks(4)}|\bx{{2,}} x{{2,}}|\b(?:{STAND_IN})\b|\b(?:{STRONG})\b|\b(?:{again})\b"
    slot = r"\{\{|[$#]\{|<%|\*\||@@|\[\[|%\(|%[a-z][a-z_]*%|<<|\{\w|\[(?:insert|your|enter) |\[[a-z]+_|__|\[object|&lt;(?:%|&lt;)"
    # a linear matcher looks nowhere ahead, and so lets through a little more
    return "|".join(_AHEAD.sub("", x).replace(" ", _SPACE) for x in (FAULT, code, rf"\b(?:{_SCRIPT})\b", filler, slot))


@lru_cache(maxsize=1 << 15)
def spoken(text: str) -> str:
    """A message in its masked form: tags away, fields, links and numbers as marks, lower case, single blanks."""
    t = _TAG.sub(" ", _SLOT.sub("<slot>", text))
    t = re.sub(rf"(?<![\w<])(?:{_SCRIPT})(?![\w>])", "javascript", _URL.sub("<url>", t).lower())
    return " ".join(_NUMBER.sub("<n>", t).split())


def template(masked: str) -> str:
    """Path and template of a masked message: number of tokens, the first ``DEPTH``, then telling tokens and ``<*>``."""
    tokens = masked.split(" ")
    telling = [False] * (len(masked) + 1)
    for form in (*_FORMS.values(), _AROUND):
        for m in form.finditer(masked):
            telling[m.start() : m.end()] = [True] * (m.end() - m.start())
    out, at = [], 0
    for i, t in enumerate(tokens):
        plain = "".join(_LETTERS.findall(t))
        keep = i < DEPTH or any(telling[at : at + len(t)]) or plain in _LATIN or plain in LITTLE or MASH.fullmatch(plain) or set(plain) == {"x"} or _ENDING.search(plain) and len(tokens) < 40
        out.append(t if keep else "<*>")
        at += len(t) + 1
    return " ".join(out)


@lru_cache(maxsize=1 << 15)
def score(t: str) -> tuple[str, float]:
    """``(kind, score)`` of a template: ``error``, ``script``, ``filler`` and how sure, or ``around`` what stands beside them."""
    tokens = t.split(" ")
    n = len(tokens)
    found = {k: [m.span() for m in f.finditer(t)] for k, f in _FORMS.items()}
    has = {k: bool(v) for k, v in found.items()}
    against = 1.5 * has["person"] + 0.9 * min(len(found["story"]), 2) + 0.5 * (t[-1:] == "?" and "robot" not in t and "human" not in t)
    spans = [s for k in ("fault", "code", "thing", "remedy", "needed", "script") for s in found[k]] + [m.span() for m in _AROUND.finditer(t)]
    covered = [False] * (len(t) + 1)
    for a, b in spans:
        covered[a:b] = [True] * (b - a)
    at, odd, own, whole = 0, 0, 0, 0
    for x in tokens:
        mine = any(covered[at : at + len(x)])
        plain = "".join(_LETTERS.findall(x))
        own += mine
        whole += mine or plain not in LITTLE
        odd += not mine and plain not in LITTLE and len(plain) > 3 and not x.startswith(("/", '"/')) or x == "<*>"
        at += len(x) + 1
    rest = odd / n
    best = {"error": 0.0, "script": 0.0, "filler": 0.0}
    if has["fault"] or has["code"]:
        # one word for a fault, and nothing that has it, says little
        against_error = against + 0.5 * (not has["code"] and not has["thing"] and all(" " not in t[a:b] for a, b in found["fault"]))
        best["error"] = 1.2 * min(len(found["fault"]), 2) + 1.1 * min(len(found["code"]), 2) + 0.6 * has["thing"] + 0.5 * has["remedy"] - (1.0 if has["code"] else 1.6) * rest - against_error
    if has["script"] and has["needed"]:
        best["script"] = 1.6 + 0.4 * has["remedy"] + 0.4 * (len(found["thing"]) > 1) - 1.2 * rest - against
    best["filler"] = _filler(t, tokens, found, has) - against
    kind = max(best, key=lambda k: best[k])
    if best[kind] >= LEAST - NEAR:
        return kind, best[kind]
    beside = not has["person"] and own >= 0.5 * whole or re.match(r"i am a bot\b", t) or _latin(t, tokens)[1]
    return ("around", 1.0) if beside else ("", 0.0)


def _latin(t: str, tokens: list[str]) -> tuple[bool, bool]:
    """Whether a template is of the filler passage, and whether it could be by the looks of its words."""
    words = _LETTERS.findall(t.replace("<*>", ""))
    known, little = sum(w in _LATIN for w in words), any(w in LITTLE and w not in _LATIN for w in words)
    like = sum(w in _LATIN or bool(_ENDING.search(w)) for w in words)
    looks = bool(words) and not little and like >= 0.75 * len(tokens)
    few = known == len(words) and len(words) > 1 and max(map(len, words)) > 4
    return looks and (len(words) >= 3 and known >= 0.15 * len(words) or few), looks


def _filler(t: str, tokens: list[str], found: dict[str, list[tuple[int, int]]], has: dict[str, bool]) -> float:
    words = _LETTERS.findall(t.replace("<*>", ""))
    if not words:
        return 0.0
    walk = [w for w in words if MASH.fullmatch(w)]
    mash = len(walk) >= 2 and len(walk) >= 0.7 * len(tokens) and any(len(w) > 3 for w in walk)
    crosses = len(tokens) >= 3 and all(set(w) == {"x"} for w in words) and sum(map(len, words)) >= 8
    # one word for text again and again
    again = len(tokens) >= 4 and len(set(words)) == 1 and (has["stand_in"] or has["text_thing"] or words[0] == "blah")
    if mash or crosses or again or _latin(t, tokens)[0]:
        return 2.0
    kinds = has["stand_in"] + has["text_thing"] + has["instruct"]
    if kinds < 2 or not (has["stand_in"] or has["strong"]):
        return 0.0
    told = [False] * (len(t) + 1)
    for k in ("stand_in", "text_thing", "instruct", "strong"):
        for a, b in found[k]:
            told[a:b] = [True] * (b - a)
    at, shown, whole = 0, 0, 0
    for x in tokens:
        if "".join(_LETTERS.findall(x)) not in LITTLE:
            whole += 1
            shown += any(told[at : at + len(x)])
        at += len(x) + 1
    return 0.75 * kinds - 1.2 + 1.2 * shown / max(whole, 1)


def unfilled(message: str) -> bool:
    """Whether a message holds a field that a form or bot left empty; people quote fields and write about them."""
    if not _SLOT.search(message):
        return False
    bare = _SLOT.sub(" ", message)
    return not _QUOTED_SLOT.search(message) and not _META.search(bare) and not _TALK.search(bare)


_OUT = "key {kind}, field boolean, words int, around int, templates array<string>, sizes array<int>"


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows that may get a verdict: ``field``, their words, those of page furniture, and the templates of their telling messages."""
    kind = df.schema[key].dataType.simpleString()
    gate = _gate()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.filter(pc.match_substring_regex(pc.utf8_lower(b.column(1)), gate))
            cut = [_CUT.split(html.unescape(x)) for x in rows.column(1).to_pylist()]
            flat = pa.array([m for ms in cut for m in ms], pa.string())
            telling = iter(pc.match_substring_regex(pc.utf8_lower(flat), gate).to_pylist())
            out: list[tuple[int, bool, int, int, list[str], list[int]]] = []
            for i, messages in enumerate(cut):
                field = machine = False
                for message in [m for m in messages if next(telling)]:
                    field = field or unfilled(message)
                    machine = machine or score(template(spoken(message)))[0] not in ("", "around")
                if not (field or machine):
                    continue
                # such a row is looked at whole: what stands beside a telling message counts too
                whole = [(t, score(t)[0], t.count(" ") + 1) for x in messages if (m := spoken(x)) and (t := template(m))] if machine else []
                own = [(t, n) for t, what, n in whole if what not in ("", "around")]
                around = sum(n for _, what, n in whole if what == "around")
                out.append((i, field, sum(n for *_, n in whole), around, [t for t, _ in own], [n for _, n in own]))
            c = list(zip(*out, strict=True)) or [[]] * 6
            types = (pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
            columns = [pa.array(list(x), t) for x, t in zip(c[1:], types, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(c[0], pa.int64())), *columns], names=["key", "field", "words", "around", "templates", "sizes"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _OUT.format(kind=kind))


def mined_templates(found: DataFrame) -> DataFrame:
    """``(template, n)``: every template of :func:`candidates` with the number of messages it was met in."""
    return found.select(F.explode("templates").alias("template")).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


def verdicts(templates: DataFrame) -> DataFrame:
    """``(template, verdict)``: each template classified once; the borderline ones only if they were met ``AGAIN`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            judged = [(t, k) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for k, s in [score(t)] if k != "around" and k and (s >= LEAST or n >= AGAIN)]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in judged], pa.string()), pa.array([k for _, k in judged], pa.string())], names=["template", "verdict"])

    return templates.select("template", "n").mapInArrow(run, "template string, verdict string")


def residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, reason)`` of every record that is machine output gone wrong.

    ``field``: it holds an unfilled field of a bot or form. ``error``, ``script``, ``filler``: at least ``MOST`` of its words, not
    counting page furniture, are messages of that sort. ``key`` must be unique; rows that share one are judged as one. Null,
    empty and blank texts, deletion marks and short texts are no cases. An empty table gives an empty result.
    """
    found = cut_lineage(candidates(df, key, text))
    templates = cut_lineage(mined_templates(found))
    messages = found.select("key", F.explode(F.arrays_zip("templates", "sizes")).alias("m")).select("key", F.col("m.templates").alias("template"), F.col("m.sizes").alias("size"))
    judged = skew_join(messages, verdicts(templates), templates, "template", "n").select("key", "verdict", "size")
    words = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("size")).otherwise(0)).alias(v)
    whole = found.select("key", "field", "words", "around", F.lit(None).cast("string").alias("verdict"), F.lit(0).alias("size"))
    part = judged.select("key", F.lit(False).alias("field"), F.lit(0).alias("words"), F.lit(0).alias("around"), "verdict", "size")
    r = whole.unionByName(part).groupBy("key").agg(
        F.max("field").alias("field"), F.sum("words").alias("words"), F.sum("around").alias("around"), words("error"), words("script"), words("filler")
    )
    machine = F.col("error") + F.col("script") + F.col("filler")
    most = (machine > 0) & (machine >= MOST * (F.col("words") - F.col("around")))
    largest = F.greatest("error", "script", "filler")
    reason = F.when(F.col("field"), "field").when(
        most, F.when(F.col("error") == largest, "error").when(F.col("script") == largest, "script").otherwise("filler")
    )
    return r.select("key", reason.alias("reason")).where("reason is not null")


def without_residue(df: DataFrame, key: str, text: str) -> DataFrame:
    """The other records of ``df``, untouched; ``key`` must be unique."""
    gone = residue(df, key, text).select(F.col("key").alias("__key"))
    return df.join(gone, df[key] == gone["__key"], "left_anti")
