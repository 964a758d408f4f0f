"""Template residue, filler and message-only texts.

Method: character n-gram models. Slots, filler and notices begin from seeds below (public messages of servers, browsers and
frameworks, delimiters of template languages), prose from a few sentences. The corpus then fits them: prose is counted over
all lines of all records that the seeds do not take for residue, and sentences of short records that stand in several records
of several sites join the filler or notice model if they are not clearly nearer to prose (``NEAR``). Only bin counts reach the driver.

Over every text, windows of ``WINDOW`` characters whose log-likelihood ratio of a residue model to the prose model is high
localise the residue. A slot there is checked by its syntax (delimiters, shape of an identifier, a null value where a
name belongs) outside quotations and code; a sentence is filler or a notice if its mean ratio is high; a record is excluded
if it has a slot or a filler sentence, or if notices cover ``COVERAGE`` of its body. Of a web page only the main body counts
(see wrappers).

Defined results: null and empty texts are not residue; text that speaks about residue, or quotes it, is not; repeated
rows give one row; a very long text is scored in one pass and judged by the same rules; an empty table is judged by seeds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import session
from siltstone.functions.urls import host
from siltstone.llm import wrappers
from siltstone.sources.tables import table

#: Characters of a window, and its mean log ratio from which it is looked at.
WINDOW, SUSPECT = 12, 0.3
#: The same for the shape of a text (letters and digits by class), in which delimiters around any name stand out.
SHAPE_WINDOW, SHAPE_SUSPECT = 1, 2.5
#: Mean log ratio per character of a sentence that is filler, or a notice.
FILLER_MEAN, NOTICE_MEAN = 0.5, 0.35
#: Share of a body that notices must cover.
COVERAGE = 0.8
#: Weight of the corpus's prose and of each residue model, in characters: models are alike at every size of a corpus.
PROSE_MASS, CLASS_MASS = 4_000_000, 150_000
#: A sentence of short records that so many records of so many sites have is a message, not prose.
RECORDS, SHORT_RECORD = 3, 300
#: Mean log ratio from which such a sentence joins the filler or the notice model.
NEAR = -0.5
ORDER, BINS = 4, 1 << 16
#: Bytes scored at once.
BLOCK = 1 << 18

# The words of the usual Latin filler; seeds of the filler model.
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna "
    "aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute "
    "irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non "
    "proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
FILLER = """
Example text that shows how the page will look; swap it for the real copy.
A dummy paragraph that fills the layout.
Placeholder copy. The final text will be supplied later.
The description will follow soon. More information is coming soon. Coming soon!
New content will appear here shortly. Nothing here yet.
Click here to add your own text and edit me. Double click to edit.
Type your paragraph here. Write a short summary here. Enter your description.
Your heading goes here. Your subtitle goes here. Add a caption here.
Testing, please ignore this entry. This is only a test post. Hello world! Welcome to WordPress. This is your first post.
The quick brown fox jumps over the lazy dog. Greeking text. Filler text. Mock text. Blind text.
Beispieltext, bitte austauschen. Dies ist ein Blindtext. Hier folgt demnächst der Text zum Projekt. Der Inhalt wird noch ergänzt.
Platzhalter für den Text. Eine Beschreibung folgt in Kürze.
Ceci est un faux texte, il sera remplacé plus tard. Le contenu sera bientôt disponible. Texte de remplissage. Exemple de paragraphe.
Este es un texto de relleno que será sustituido. El contenido estará disponible en breve. Aquí se añadirá la descripción. Párrafo de muestra.
""".strip().split("\n")  # fmt: skip
MASHED = ("test", "asdf", "qwer", "blah", "xxx", "text", "foo bar", "bla", "abc", "aaa", "dummy", "sample", "jkl")

# Seeds of the notice model: messages of public servers, browsers, libraries and frameworks.
NOTICES = """
Not Found. The requested URL was not found on this server. HTTP Error 404.0 - Not Found
The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.
Sorry, the page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.
Oops, that page can't be found. It looks like nothing was found at this location. Maybe try a search? This link is broken.
Go to the homepage. Take me back to the start. Use the search box to find what you need.
Forbidden - you don't have permission to access this resource on this server. You are not authorised to view this document.
Unauthorized. Access to this page is denied by the security policy. Your request has been rejected by the administrator. Sorry, you have been blocked.
HTTP 500: the server encountered an internal error or misconfiguration and was unable to complete your request.
Bad Gateway. The proxy server received an invalid response from an upstream server. The web server reported a gateway time-out error.
Service Unavailable. The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.
We're sorry, but something went wrong. Whoops, looks like something went wrong on our end. Try refreshing the page in a few minutes.
We are currently performing scheduled maintenance. We will be back shortly. Thank you for your patience. The website is offline for an upgrade.
The connection has timed out. The server at this address is taking too long to respond. Upstream request timeout.
You have sent too many requests in a given amount of time. Rate limited; slow down and retry after a minute.
If this problem continues, please contact the site owner or the support desk. Reference number 18. Error code 1020. Ray ID: 8a2f
Parse error: syntax error, unexpected end of file in index.php on line 40. Uncaught TypeError: argument must be of type array. Stack trace:
Warning: include(header.php): failed to open stream: no such file or directory in wp-content/themes/functions.php on line 7
File "manage.py", line 22, in main: ValueError: invalid literal for int() with base 10. Unhandled exception: java.lang.NullPointerException
Error establishing a database connection. Could not connect to the database: too many connections, sorry
You need to log in to view this content. Login required. Please sign in to your account to read on. Members only: register or subscribe to continue reading.
Your session has timed out due to inactivity. Please log in again. Your login has expired. Invalid username or password.
This domain name is for sale. The domain is parked free, courtesy of the registrar. Make an offer to buy this domain name from its owner.
You need to enable JavaScript to run this app. JavaScript is disabled in your browser. Please turn JavaScript on and reload the page.
This website needs scripts to work. Your browser does not support JavaScript or has scripts switched off. It won't display properly without them.
Loading, please wait... If the page does not load, check that no extension blocks scripts. Redirecting, click here if nothing happens.
Please wait while we check your browser. Verify you are human by completing the action below. Confirm that you're not a robot. It may take some seconds.
Our systems have detected unusual traffic from your computer network. Complete the security check to access the site. Your IP address was flagged.
This video is not available in your country. The file has been deleted by the author. The content was withdrawn and can't be shown.
An unexpected error has occurred. An error occurred during the processing of your request. Something happened and we could not process it.
Please enable cookies and reload the page. Your browser is out of date; please update it to use this site. This account has been suspended. Under construction.
Sie müssen JavaScript einschalten, damit diese Anwendung läuft. Bitte schalten Sie JavaScript in Ihrem Browser ein.
Die gesuchte Seite konnte nicht gefunden werden. Fehler 404: Diese Adresse gibt es nicht oder nicht mehr.
Kein Zugriff auf diese Seite. Melden Sie sich an, um den Inhalt zu lesen. Anmeldung erforderlich.
Wegen Wartung ist der Dienst zurzeit nicht erreichbar. Bitte probieren Sie es in Kürze noch einmal.
Leider ist ein unerwarteter Fehler passiert. Die Sitzung ist abgelaufen, bitte neu anmelden.
Vous devez activer JavaScript pour utiliser ce site. Votre navigateur n'exécute pas les scripts.
La page demandée n'existe pas ou a été déplacée. Erreur 404, page non trouvée. Retournez à la page d'accueil ou vérifiez le lien.
Vous n'avez pas accès à cette page. Connectez-vous pour lire ce contenu. Identification requise.
Le service est temporairement indisponible pour cause de maintenance. Merci de réessayer dans quelques minutes.
Une erreur inattendue s'est produite. La session a expiré, reconnectez-vous.
Debe activar JavaScript en su navegador para usar esta página web.
No se ha encontrado la página. Error HTTP 404: la dirección no existe o ha sido movida. Vuelva a la página de inicio.
No tiene permiso para ver esta página. Debe iniciar sesión para leer el contenido. Acceso restringido.
El servicio no está disponible por tareas de mantenimiento. Inténtelo de nuevo dentro de unos minutos.
Ha ocurrido un error inesperado. La sesión ha caducado, identifíquese otra vez.
""".strip().split("\n")  # fmt: skip

# A little prose of four languages, so that the prose model has a floor where a corpus has hardly any text.
PROSE = """
The crane of the quay was lifted in the storm, and the workers of the harbour spent most of May on its repair.
When the winter was over, the council of the town decided that the old mill should be given to a group of farmers.
Many of the people who live in the valley remember how the river rose above the bridge and took the lower houses.
She had read the report twice, yet she could not say which of the figures had been measured and which were estimates.
A small company from the north now makes the parts that were once bought abroad, and its prices have hardly changed.
The results of the second trial agree with those of the first, although fewer members took part and the weather was bad.
Im Herbst wurde die Brücke gesperrt, weil die Pfeiler nach dem Hochwasser nicht mehr sicher waren und niemand haften wollte.
Die Genossenschaft prüft seit dem Frühjahr, ob sich der Anbau lohnt und wie die Kosten unter den Mitgliedern verteilt werden.
Viele Betriebe in der Region haben ihre Anlagen erneuert, obwohl die Förderung erst im nächsten Jahr ausgezahlt wird.
Le conseil de la ville a décidé de réparer le pont avant l'hiver, car les habitants de la vallée en dépendent chaque jour.
Les agriculteurs partagent les machines depuis trois ans, ce qui réduit les frais et laisse plus de temps pour la récolte.
La empresa del norte fabrica ahora las piezas que antes se compraban fuera, y los precios apenas han cambiado desde entonces.
Los vecinos del valle recuerdan cómo el río subió por encima del puente y se llevó las casas que estaban más abajo.
"""

# Seeds of the slot model: delimiters of template languages around names of fields.
_NAMES = "FNAME user.name post_title item.price company_name lastname order_id customer.city event_date phone_number job_title account.owner zip_code product image_url page.author".split()
_WRAPS = ("{{%s}}", "{%s}", "${%s}", "#{%s}", "[[%s]]", "<%%= %s %%>", "{%% include %s %%}", "&lt;%s&gt;", "<%s>", "<enter %s>", "*|%s|*", "@Model.%s")
_UPPER = ("[%s]", "%%%%%s%%%%", "%%%s%%", "__%s__", "@@%s@@", "$%s$", "<<%s>>", "[ENTER %s]", "[YOUR %s HERE]", "%s_PLACEHOLDER")
_EMPTY = ("Hello %s, welcome.", "Welcome back %s!", "Author: %s.", "Published by %s", "from %s to %s.", "%s, %s", "In %s, we met.", "The %s offers a grant", "for %s.", "%s opens the door", "Hi %s,")
SLOTS = [w % n for n in _NAMES for w in _WRAPS] + [w % n.replace(".", "_").upper() for n in _NAMES for w in _UPPER]
SLOTS += [w.replace("%s", v) for w in _EMPTY for v in ("undefined", "null", "None", "NaN", "[object Object]")] * 3
SLOTS += ["TODO: write this", "FIXME: check", "XXXXX", "Your subtitle goes here", "Your name here", "to be filled in later by the author"] * 3

# Elements of HTML, which are no names of fields.
_TAGS = set(
    "a abbr article aside audio b blockquote body br button canvas caption center code col dd del details dialog div dl dt em fieldset figcaption figure font "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark meta nav noscript object ol option p param picture pre q "
    "s samp script section select small source span strong style sub sup svg table tbody td template textarea tfoot th thead time title tr track u ul var video wbr".split()
)
_QUOTED = re.compile(r'"[^"\n]{0,200}"|“[^”\n]{0,200}”|„[^“\n]{0,200}“|«[^»\n]{0,200}»|‘[^’\n]{0,200}’|`[^`\n]{0,300}`|```.*?```', re.DOTALL)
_WORDS = r"[A-Za-z][A-Za-z_. ]{1,40}"
_DELIMITED = re.compile(
    # Delimiters that prose has no use for, whatever lies between them.
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}%\}|<%[^<>\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|\*\|[^|\n]{1,40}\|\*"
    rf"|\[\[\s*{_WORDS}\]\]|<<\s*{_WORDS}>>|@@[A-Za-z][A-Za-z_.]{{1,40}}@@|%%[A-Za-z][A-Za-z_.]{{1,40}}%%|\[object Object\]"
    # Weaker ones around the shape of a name or an instruction.
    rf"|(?<![\w\\}}])\{{\s*[A-Za-z][A-Za-z_. ]{{2,40}}\}}|\[(?:[A-Z]+[_.][A-Z_.]+|[A-Z]{{5,}}|[A-Z]{{2,}}(?: [A-Z]{{2,}})+)\]"
    r"|[\[<](?i:insert|enter|add|your|type|choose|select)\b[^\]<>\n]{1,40}[\]>]"
    r"|%[A-Z][A-Z_.]{2,40}%|\$[A-Z][A-Z_.]{2,40}\$|\b__[A-Za-z][A-Za-z_.]{2,40}__\b|(?<!\w)@[A-Z][A-Za-z]+\.[A-Z]\w+"
    r"|\b(?:TODO|FIXME):|\b[A-Z]{2,12}_PLACEHOLDER\b|\bX{4,}\b"
    r"|\b(?i:your) [a-z]{3,12} (?:goes )?here\b|\bto be (?:completed|filled in|supplied|added|written) (?:later )?by the \w+"
)
_ELEMENT = re.compile(r"(?:<|&lt;)\s*([A-Za-z][A-Za-z_. ]{2,40})(?:>|&gt;)")
#: A null value, what stands before it in its sentence, and after it.
_NULL = re.compile(r"(?<![\w./-])(?:undefined|null|None|NaN)(?![\w/-]|\.\w)")
_STATED = re.compile(r"\b(?:is|are|was|were|be|been|being|remains?|returns?|returned|returning|equals?|becomes?|became|or|not|left|of|as|than|contains?|with|called|says?|said|prints?|shows?|means?)\s+(?:an?\s+|the\s+)?$", re.IGNORECASE)
_ARTICLE = re.compile(r"\b(?:an?|the|any|some|each|every|this|that|no|these|those)\s+$", re.IGNORECASE)
_VERB = re.compile(r"\s+(?:will|would|can|cannot|could|shall|may|must|has|have|had)\b|\s+[a-z]+\s+(?:an?|the|[a-z]+ing|our|its|their)\b")
_PRONOUN = re.compile(r"\s+(?:of|the\s?less|but|other|too|so|is|are|was|were|has|have|had|can|could|will|would|did|do|does|may|might|should|need|yet|other)\b")


def is_null(before: str, value: str, after: str) -> bool:
    """Whether a null value stands where a name or a figure belongs: nothing is said about it and it belongs to no noun."""
    if value == "NaN":
        return not _STATED.search(before) and not re.match(r"\s+(?:values?|results?|errors?|entries|cells?|checks?)\b", after)
    first = not before.strip() or before.rstrip()[-1:] in ".!?"
    if value == "None":
        return not _PRONOUN.match(after) if first else not re.match(r"\s+of\b", after) and not _STATED.search(before)
    if _STATED.search(before):
        return False
    noun = re.match(r"\s+[a-z]+", after)
    return bool(_VERB.match(after)) if _ARTICLE.search(before) else not noun or first or bool(_VERB.match(after) or re.match(r"\s+(?:and|or|before|after|null|to|in|on|at|by|for)\b", after))


def has_slot(text: str) -> bool:
    """Whether a text outside quotations has a slot that was never filled."""
    if _DELIMITED.search(text):
        return True
    for m in _ELEMENT.finditer(text):
        name = m.group(1).strip()
        if name.lower() not in _TAGS and f"</{name}" not in text and (m.group(0)[0] == "&" or "_" in name or "." in name or name.islower()):
            return True
    return any(is_null(text[max(0, m.start() - 40) : m.start()], m.group(0), text[m.end() : m.end() + 40]) for m in _NULL.finditer(text))


_MASH = re.compile(r"\b(\w{2,8}(?: \w{1,6})?)(?:[\s,]+\1\b){3,}", re.IGNORECASE)
_SENTENCES = re.compile(r"(?<=[.!?…])[\"'”’»)]*\s+|\n+")


def grams(text: bytes) -> np.ndarray:
    """Bin of the ORDER bytes that begin at each place of text."""
    a = np.frombuffer(text + b"\n" * (ORDER - 1), np.uint8).astype(np.uint32)
    h = np.zeros(len(a) - ORDER + 1, np.uint32)
    for k in range(ORDER):
        h = (h * np.uint32(0x01000193)) ^ a[k : len(a) - ORDER + 1 + k]
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 16)


_SHAPE = bytes(97 if chr(b).islower() or b > 127 else 65 if chr(b).isupper() else 48 if 48 <= b < 58 else b for b in range(256))


def counted(text: bytes | str) -> np.ndarray:
    """How often each bin is in text."""
    return np.bincount(grams(text.encode() if isinstance(text, str) else text), minlength=BINS).astype(np.float64)


def _seeds(seed: int = 7) -> tuple[np.ndarray, ...]:
    """Bin counts of the seeds: slot, filler, notice, shape of slots; prose, shape of prose."""
    rng = np.random.default_rng(seed)
    latin = " ".join(rng.choice(LATIN, 6000))
    latin += " ".join(f"{' '.join(rng.choice(LATIN, 8)).capitalize()}{m}" for m in (". ", ", ", "; ") for _ in range(200))
    mashed = "\n".join(" ".join([m] * 8) for m in MASHED)
    around = "".join(x + (" ", ", ", ". ", " and ")[k % 4] for k, x in enumerate(SLOTS))
    texts = (around, latin + "\n" + "\n".join(FILLER * 24) + mashed * 3, "\n".join(NOTICES))
    return (*map(counted, texts), counted(texts[0].encode().translate(_SHAPE)), counted(PROSE), counted(PROSE.encode().translate(_SHAPE)))


def train(prose: np.ndarray | None = None, filler: np.ndarray | None = None, notice: np.ndarray | None = None, shape: np.ndarray | None = None) -> np.ndarray:
    """Rows slot, filler, notice, shape: log ratios of the bins to prose, from the seeds and the bin counts found in a corpus."""
    *classes, floor, floor_shape = _seeds()
    log = lambda c: np.log((c + 0.5) / (c + 0.5).sum())
    scaled = lambda c, mass: c * (mass / max(1.0, c.sum()))
    # Prose seeds keep a floor where a corpus has hardly any text; its weight grows with the text there is, up to the mass.
    base = [log(f * 8 + (scaled(c, min(PROSE_MASS, c.sum())) if c is not None else 0)) for f, c in ((floor, prose), (floor_shape, shape))]
    out = []
    for k, (seeds, found) in enumerate(zip(classes, (None, filler, notice, None))):
        mixed = scaled(seeds, CLASS_MASS)
        if found is not None and found.sum():
            mixed = (mixed + scaled(found, CLASS_MASS)) / 2
        # A bin that no prose has is worth no more than a rare one, so that new names and words of prose stay neutral.
        out.append(np.clip(log(mixed) - base[k == 3], -3.0, 4.0))
    return np.stack(out).astype(np.float32)


class Scorer:
    """Scores texts with trained log ratios."""

    def __init__(self, ratios: np.ndarray):
        self.ratios = ratios

    def hot(self, raw: bytes, rows: slice, window: int, least: float) -> np.ndarray:
        """Where a window begins over which the mean log ratio of one of the rows is high."""
        sums = np.zeros((len(self.ratios[rows]), len(raw) + 1), np.float64)
        np.cumsum(self.ratios[rows][:, grams(raw)], axis=1, out=sums[:, 1:])
        return (sums[:, window:] - sums[:, :-window] > least * window).any(axis=0)

    def suspects(self, texts: list[str]) -> np.ndarray:
        """Which texts have a window of a high ratio; they are scored in blocks of one buffer, so memory stays bounded."""
        raws = [t.encode() for t in texts]
        starts = np.cumsum([0] + [len(r) + 1 for r in raws])
        raw = b"\n".join(raws) + b"\n"
        hot = np.zeros(len(raw) + 1, bool)
        for at in range(0, len(raw), BLOCK):
            block = raw[at : at + BLOCK + WINDOW]
            for text, rows, window, least in ((block, slice(0, 3), WINDOW, SUSPECT), (block.translate(_SHAPE), slice(3, 4), SHAPE_WINDOW, SHAPE_SUSPECT)):
                if len(text) > window:
                    found = self.hot(text, rows, window, least)
                    hot[at : at + len(found)] |= found
        count = np.concatenate([[0], np.cumsum(hot, dtype=np.int32)])
        return count[starts[1:] - 1] > count[starts[:-1]]

    def mean(self, raw: bytes) -> np.ndarray:
        """Mean log ratios over raw, taken block by block."""
        total = sum((self.ratios[:, grams(raw[at : at + BLOCK])].sum(axis=1, dtype=np.float64) for at in range(0, len(raw), BLOCK)), np.zeros(len(self.ratios)))
        return total / max(1, len(raw))

    def judge(self, line: str) -> tuple[bool, bool, int, int]:
        """(has a slot, has filler, characters of notices, characters) of one line."""
        bare = _QUOTED.sub(" ", line)
        slot = has_slot(bare)
        filler, notice, total = bool(_MASH.search(bare)), 0, 0
        for sentence in _SENTENCES.split(line):
            raw = sentence.strip().encode()
            if not raw:
                continue
            mean = self.mean(raw)
            total += len(raw)
            if mean[1] > FILLER_MEAN and mean[1] > mean[2]:
                filler = True
            if mean[2] > NOTICE_MEAN:
                notice += len(raw)
        return slot, filler, notice, total


def _blocks(texts) -> Iterator[bytes]:
    """The texts as lines, in blocks of about BLOCK bytes."""
    held, size = [], 0
    for t in texts:
        raw = t.encode()
        held.append(raw)
        size += len(raw)
        if size >= BLOCK:
            yield b"\n".join(held) + b"\n"
            held, size = [], 0
    if held:
        yield b"\n".join(held) + b"\n"


def _rows(counts: np.ndarray, kind: int) -> pd.DataFrame:
    at = np.flatnonzero(counts)
    return pd.DataFrame({"kind": np.full(len(at), kind, np.int32), "bin": at.astype(np.int32), "n": counts[at]})


def _total(rows: list, kind: int) -> np.ndarray:
    """The counts of a kind, of at most BINS rows (kind, bin, n) of each."""
    out = np.zeros(BINS)
    for r in rows:
        if r.kind == kind:
            out[r.bin] = r.n
    return out


def _prose_bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bin counts of the lines that the seeds do not take for residue."""
    scorer, counts, shapes = Scorer(train()), np.zeros(BINS), np.zeros(BINS)
    for f in batches:
        for raw in _blocks(f["text"]):
            codes = grams(raw)
            ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
            starts = np.append(0, ends[:-1] + 1)
            sizes = np.diff(np.append(starts, len(raw)))
            means = np.add.reduceat(scorer.ratios[:, codes], starts, axis=1, dtype=np.float64) / sizes
            clean = (means[0] < SUSPECT) & (means[1] <= FILLER_MEAN) & (means[2] <= NOTICE_MEAN)
            keep = np.repeat(clean, sizes)
            counts += np.bincount(codes[keep], minlength=BINS)
            shapes += np.bincount(grams(raw.translate(_SHAPE))[keep], minlength=BINS)
    yield _rows(counts, 0)
    yield _rows(shapes, 3)


def _messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        rows = [(k, site, s) for k, site, text in zip(f["k"], f["site"], f["text"]) for s in {_DIGITS.sub("0", x.strip()) for x in _SENTENCES.split(text)} if s]
        yield pd.DataFrame(rows, columns=["k", "site", "s"])


_DIGITS = re.compile(r"\d+")


def fitted(texts: DataFrame, short: DataFrame) -> np.ndarray:
    """Log ratios fitted to a corpus: prose by all of texts (text), messages by the short records of short (k, site, text)."""
    bins = session.spread(texts.where("text <> ''")).mapInPandas(_prose_bins, "kind int, bin int, n double").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()
    prose, shape = _total(bins, 0), _total(bins, 3)
    sentences = short.where((F.col("text") != "") & (F.length("text") <= SHORT_RECORD)).mapInPandas(_messages, "k string, site string, s string")
    often = sentences.groupBy("s").agg(F.count_distinct("k").alias("records"), F.count_distinct("site").alias("sites")).where((F.col("records") >= RECORDS) & (F.col("sites") >= RECORDS)).select("s")
    ratios = train(prose, shape=shape)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer, counts = Scorer(ratios), {1: np.zeros(BINS), 2: np.zeros(BINS)}
        for f in batches:
            for s in f["s"]:
                mean = scorer.mean(s.encode())
                kind = 1 if mean[1] > mean[2] else 2
                if mean[kind] > NEAR:
                    counts[kind] += counted(s)
        for kind, c in counts.items():
            yield _rows(c, kind)

    found = often.mapInPandas(near, "kind int, bin int, n double").groupBy("kind", "bin").agg(F.sum("n").alias("n")).collect()
    return train(prose, _total(found, 1), _total(found, 2), shape)


def _verdicts(scorer_ratios, key: str):
    """mapInPandas function: (key, lines array<struct<no, slot, filler, notice, size>>) of texts with a suspect line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(scorer_ratios.value)
        for f in batches:
            keys, out = [], []
            split = [t.split("\n") for t in f["text"]]
            flat = [line for lines in split for line in lines]
            hot = scorer.suspects(flat)
            at = 0
            for k, lines in zip(f[key], split):
                flags = hot[at : at + len(lines)]
                at += len(lines)
                if not flags.any():
                    continue
                rows = []
                for no, line in enumerate(lines):
                    if not line.strip():
                        continue
                    slot, filler, notice, size = scorer.judge(line) if flags[no] else (False, False, 0, len(line.strip().encode()))
                    rows.append({"no": no, "slot": slot, "filler": filler, "notice": notice, "size": size})
                if any(r["slot"] or r["filler"] or r["notice"] for r in rows):
                    keys.append(k)
                    out.append(rows)
            if keys:
                yield pd.DataFrame({key: keys, "lines": out})

    return run


_LINES = "lines array<struct<no:bigint,slot:boolean,filler:boolean,notice:bigint,size:bigint>>"


def judged(texts: DataFrame, key: str, ratios) -> DataFrame:
    """(key, lines) of the texts (key, text) that have a residue line, with the verdict on each of their lines."""
    rows = texts.where(F.col("text") != "").select(key, "text")
    return session.spread(rows).mapInPandas(_verdicts(ratios, key), f"{key} string, {_LINES}")


def is_residue(lines) -> F.Column:
    """Whether the lines of a body make its record residue."""
    add = lambda name: F.aggregate(lines, F.lit(0).cast("bigint"), lambda a, x: a + x[name])
    covered = (add("notice") > 0) & (add("notice") >= COVERAGE * add("size"))
    return F.exists(lines, lambda x: x["slot"] | x["filler"]) | covered


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records of crawl_cache.clean_text and canonical_evidence.evidence_excerpt that hold residue."""
    pages = table(spark, folder, "crawl_cache", "url", F.col("clean_text").alias("text"))
    excerpts = table(spark, folder, "canonical_evidence", "evidence_id", F.col("evidence_excerpt").alias("text"))
    source = table(spark, folder, "canonical_evidence", F.col("evidence_id").alias("k"), host(F.col("source_url")).alias("site"), F.col("evidence_excerpt").alias("text"))
    ratios = spark.sparkContext.broadcast(fitted(pages.select("text").unionByName(excerpts.select("text")), source))
    page_lines = session.cut(judged(pages, "url", ratios))
    body = wrappers.segmented(wrappers.crawl(spark, folder)).select("url", "body", "heads")
    rows = page_lines.join(body, "url")
    inside = F.filter("lines", lambda x: F.array_contains("body", x["no"]))
    # The heading is part of the body, but a page with a heading and a message alone has but the message.
    content = F.filter(inside, lambda x: ~F.array_contains("heads", x["no"]) | x["slot"] | x["filler"])
    found = rows.where(is_residue(content)).select(F.lit("crawl_cache").alias("table_name"), F.col("url").alias("row_key"))
    lines = judged(excerpts, "evidence_id", ratios)
    other = lines.where(is_residue(F.col("lines"))).select(F.lit("canonical_evidence").alias("table_name"), F.col("evidence_id").alias("row_key"))
    return found.unionByName(other).distinct()
