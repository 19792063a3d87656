import pytest

from loomline.llm.residue import candidates, mined_templates, residue, without_residue

SCHEMA = "line_no long, body string, key string, reason int"
CASES = [
    ("Hi {{ name }}! Thanks for posting in %(subreddit)s. A moderator will look at it soon.", "field"),
    ("Your post about the map was removed under rule <%= rule %>. Message the moderators if you disagree.", "field"),
    ("[INSERT TITLE] was posted by *|NAME|* on @@date@@.", "field"),
    ("This thread has been locked. Reason: [object Object]", "field"),
    ("HELLO #{TITLE}, YOUR SUBMISSION %(TITLE)S HAS BEEN REMOVED.", "field"),
    ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt.", "filler"),
    ("Placeholder paragraph. Placeholder paragraph.", "filler"),
    ("text text text text text text", "filler"),
    ("asdf qwer asdf sdfg jkl", "filler"),
    ("404 Not Found", "error"),
    ("HTTP Error 503: Service Unavailable. The requested URL /x could not be served on this server.", "error"),
    ("&lt;html&gt;&lt;head&gt;&lt;title&gt;502 Bad Gateway&lt;/title&gt;&lt;/head&gt;&lt;body&gt;&lt;h1&gt;502 Bad Gateway&lt;/h1&gt;&lt;/body&gt;&lt;/html&gt;", "error"),
    ('Traceback (most recent call last):\n  File "/srv/a.py", line 3, in render\nKeyError: \'x\'', "error"),
    ("Home | Forum | Log in\nAccess denied. You don't have permission to access this resource. Ray 1f2e3d\n© all rights reserved", "error"),
    ("Please enable Java  Script to view this page.", "script"),
    ("You need to enable JS to run this app. Checking your connection…", "script"),
    ("Bitte aktivieren Sie scripts, um diese Seite zu sehen.", "script"),
]
OTHERS = [
    "Their press release still had {{name}} in it, that is how careful these people are.",
    'The letter starts with "Dear [INSERT NAME]" so of course it is a form letter.',
    "printf with %s and no argument, that is how they leaked their own memory.",
    "In the code you can see ${path} is built from user input, that is the whole exploit.",
    "Access denied is what the door said, so we went around the back.",
    "Please enable your brain before you enable javascript on a site like that.",
    "I browse with javascript disabled, so I never saw the popup you mention.",
    "Half of that report reads like lorem ipsum, did anybody proofread it?",
    "Anyone else getting 503 service unavailable on the archive?",
    "[deleted]",
    "[removed]",
    "",
    "   ",
    "this",
    None,
    "👍",
    "I am a bot and this action was performed automatically.",
]


def test_cases_and_decoys(spark):
    bodies = [b for b, _ in CASES] + OTHERS
    df = spark.createDataFrame([(i, b, "clash", 1) for i, b in enumerate(bodies)], SCHEMA).repartition(3)
    got = {r["key"]: r["reason"] for r in residue(df, "line_no", "body").collect()}
    assert got == {i: r for i, (_, r) in enumerate(CASES)}
    rest = without_residue(df, "line_no", "body")
    assert rest.columns == df.columns and {r["body"] for r in rest.collect()} == set(OTHERS)


@pytest.mark.parametrize("wrap", [str.upper, lambda s: f"\n\n{s}\n\n", lambda s: s + "\n\nI am a bot and this action was performed automatically.", lambda s: s.replace(" ", "  ")])
def test_spelling_and_furniture(spark, wrap):
    df = spark.createDataFrame([(i, wrap(b), "", 0) for i, (b, r) in enumerate(CASES) if r != "field" and "<" not in b and "&lt" not in b], SCHEMA)
    assert residue(df, "line_no", "body").count() == df.count()


def test_very_long_and_empty(spark):
    long_ = "word and other words. " * 30_000
    df = spark.createDataFrame([(1, long_ + "Hello {{ name }}, welcome.", "", 0), (2, long_, "", 0)], SCHEMA)
    assert [r["key"] for r in residue(df, "line_no", "body").collect()] == [1]
    assert residue(df.limit(0), "line_no", "body").count() == 0


def test_a_benign_sibling_changes_nothing(spark):
    notice = "You need to enable JavaScript to run this app."
    bodies = [notice] * 20 + ["You need to enable your brain to think straight."] + ["You need to enable the other seven theories here."] * 50
    df = spark.createDataFrame([(i, b, "", 0) for i, b in enumerate(bodies)], SCHEMA).repartition(5)
    assert sorted(r["key"] for r in residue(df, "line_no", "body").collect()) == list(range(20))


def test_templates_are_the_same_however_rows_are_spread(spark):
    rows = [(i, f"Error {500 + i % 4}: the request for k{'abcdefgh'[i % 8]}k could not be completed.", "", 0) for i in range(64)]
    df = spark.createDataFrame(rows, SCHEMA)
    one, many = ({tuple(r) for r in mined_templates(candidates(df.repartition(p), "line_no", "body")).collect()} for p in (1, 7))
    assert one == many == {("error <n>: the request for <*> could not be completed.", 64)}


# Written after the classifier's vocabulary and never used to choose it.
UNSEEN = """The specified URL cannot be found.
HTTP 404 - File or directory not found
Gateway Timeout: the proxy server did not receive a timely response from the upstream server.
Unable to connect to the database server at this time.
This video is no longer available.
We're sorry, but something went wrong. Please reload the page.
You have exceeded your API request quota. Please try again later.
The connection has timed out
DNS_PROBE_FINISHED_NXDOMAIN: this site can't be reached
Oops, that page can't be found.
Login failed: invalid token
ModuleNotFoundError: No module named 'requests'
Warning: include(header.php): failed to open stream in /var/www/html/index.php on line 3
Exception in thread main java.lang.IllegalStateException at org.app.Start.run(Start.java:88)
{"code": 401, "message": "Unauthorized"}
<html><head><title>500 Internal Server Error</title></head><body><h1>500 Internal Server Error</h1><p>The server encountered an error.</p></body></html>
The service is temporarily unavailable. Please check back in a few minutes.
Our systems have detected unusual traffic from your network.
Bad Request. Your browser sent a request that this server could not understand.
Please verify you are a human to continue.
You do not have permission to view this page.
This content is not available in your region.
Your request could not be processed. Please contact support.
The website is currently down for scheduled maintenance.
Fehler 404: Seite nicht gefunden
Der Server ist zurzeit nicht erreichbar. Bitte versuchen Sie es später noch einmal.
Ihre Sitzung ist abgelaufen. Bitte melden Sie sich erneut an.
Ce service est momentanément indisponible.
Impossible d'afficher la page : accès interdit.
Error 404. Página no encontrada.
El servicio no está disponible en este momento. Inténtelo más tarde.
Please turn on JavaScript in your browser and reload the page.
This application requires JavaScript.
Scripts are disabled. Enable them to see the comments.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Active JavaScript is required: please enable JavaScript and refresh.
JavaScript debe estar habilitado para ver este sitio.
Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip.
Nemo enim ipsam voluptatem quia voluptas sit aspernatur aut odit aut fugit.
Sample text. Replace with your own text.
Enter your description here
placeholder placeholder placeholder placeholder
zxcv asdf qwer zxcv asdf
Texto de ejemplo para el título.
Hello {{customer.first_name}}, we have received your ticket.
Dear [FIRST_NAME] [LAST_NAME], your appointment is confirmed.
Your code is ${otp_code} and expires soon.
Hola {nombre}, gracias por tu mensaje.
Posted by %AUTHOR% on %DATE%
Reset your password: <%= reset_url %>""".split("\n")
PEOPLE = """The website of the ministry was down for hours after the story broke.
Access to the site was denied to every reporter on the list.
I cannot find the page where they admit it.
We were told the file could not be found, which nobody believed.
My browser is full of tabs about this case.
Does the archive link work for anyone else?
The server room burned in 1998, together with the logs.
She requested the documents and they said the office was closed.
You can turn off scripts in that browser and the popup goes away, I do it all the time.
He wrote the script for the film in nine days.
The error in the table is on page 14, third row.
That account was suspended because he posted the map.
The bridge was closed for maintenance when it happened.
The permission came from the governor himself.
Time ran out before the witness could answer.
It says page not found when I click, but the cached copy is still there.
Nobody could load the truck that fast.
Please stop posting this, it was debunked years ago.
Thank you for your patience with my long posts.
The content of the box was never listed.
A test flight over the base, nothing more.
For example, the title of the film changed twice.
The sample they sent to the lab came back empty.
Someone should replace the text on that plaque.
Lorem ipsum is what they print when they have nothing to say.
Sic transit gloria mundi, as my teacher liked to say.
yes yes yes yes yes
wow wow wow wow
Error is human, covering it up takes a committee.
The internal report lists four errors of the server company.
404 witnesses and not one photo.
They went offline the minute the hearing started.
His passport had expired, so they let him go.
The forum was under attack that week.
The link you posted leads to a story about cats.
The address on the letter does not exist, I drove there.
The app tracks you even if it is closed.
Die Akte wurde im Archiv nicht gefunden, sagt der Beamte.
Le dossier est introuvable depuis 1987.
El testigo no existe, lo inventaron ellos.
The variable {x} in that formula is the distance in miles.
They forgot to fill in {{date}} before they sent the press release.
What does "%USERNAME%" mean in the file path he showed?
The request for comment was refused by the company.
Bad weather, bad gateway to the valley, bad luck.
The service at the base was suspended after the crash.
The host of the show interrupted the guest three times.
A timeout was called four seconds before the end of the game.
The system failed these people.
The session started late and the mayor left early.""".split("\n")


def test_held_out_templates(spark):
    df = spark.createDataFrame([(i, b, "", 0) for i, b in enumerate(UNSEEN + PEOPLE)], SCHEMA)
    got = {r["key"] for r in residue(df, "line_no", "body").collect()}
    hit = sum(i < len(UNSEEN) for i in got)
    assert hit >= 0.9 * len(UNSEEN) and hit >= 0.9 * len(got), [(UNSEEN + PEOPLE)[i] for i in got.symmetric_difference(range(len(UNSEEN)))]
