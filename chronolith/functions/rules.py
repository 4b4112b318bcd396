"""Rule dictionaries and the column expressions that apply them.

Every function takes its rules as a parameter; the ones here are the defaults. Patterns are Java regular expressions
once ``java`` has added the flags that make them Unicode-aware.
"""

from __future__ import annotations

import functools
import re
from re import _constants as constants
from re import _parser as parser

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, patterns and weights that results depend on.
TOPICS = (
    ("CI/CD", r"\bci\b|\bcd\b|ci.?cd|pipeline|build|deploy|despliegue|jenkins|argo|gitlab|integraci[oó]n continua"),
    ("QA / Pruebas", r"\bqa\b|prueba|\btest\b|xray|sonar|trivy|calidad|cobertura"),
    ("Jira / HDU", r"\bjira\b|historia|backlog|sprint|[eé]pica|refin|planner|criterio"),
    ("Agente / Framework", r"\bagente|ag[eé]ntic|framework|devin|copilot|cascade|\bprompt"),
    ("Código / PR", r"c[oó]digo|pull request|\bpr\b|commit|repositori|\bgit\b|merge"),
    ("API / Mesa", r"\bapi\b|open.?api|spectral|swagger|endpoint|\bmesa\b"),
    ("Visualizador / Front", r"visualizador|front|\bhost\b|navegaci[oó]n|pantalla|dashboard"),
    ("MCP / Integración", r"\bmcp\b|integraci[oó]n|conect|servidor|protocolo"),
)
INTENT = (
    r"\b(vamos a|voy a|vamos\b|lo que (?:vamos|voy) a hacer|el objetivo es|la idea es|"
    r"queremos (?:demostrar|mostrar|ver|probar)|a continuaci[oó]n|lo siguiente|"
    r"ahora (?:vamos|veremos|voy|ejecut|revis|mostrar|les muestro)|"
    r"vamos a (?:probar|mostrar|revisar|ver|ejecutar|hacer|demostrar))\b"
)
ARTIFACT_SIGNALS = (
    ("excel", (r"\.xls[xmb]?\b", r"\bexcel\b", r"\bhoja\s?\d", r"\blibro\d*\b", r"\bsheet\d*\b", r"\btabla\s+din[aá]mica\b", r"\bpromedio\b", r"\bsuma\b", r"\bceldas?\b", r"\bf[oó]rmulas?\b", r"\bautosuma\b", r"\bfila[s]?\b.*\bcolumna")),
    ("word", (r"\.docx?\b", r"\bword\b", r"\binterlineado\b", r"\bp[aá]rrafo\b", r"\bencabezado\b", r"\bcontrol\s+de\s+cambios\b", r"\bnota\s+al\s+pie\b")),
    ("powerpoint", (r"\.pptx?\b", r"\bpowerpoint\b", r"\bdiapositiva", r"\bpresentaci[oó]n\b", r"\bpatr[oó]n\s+de\s+diapositiva", r"\bslide\s?\d")),
    ("jira_planner", (r"\bjira\b", r"\bsprint\b", r"\bbacklog\b", r"\bplanner\b", r"\bkanban\b", r"\btablero\b", r"\bhistoria\s+de\s+usuario\b", r"\bstory\s+points?\b", r"\bepic\b", r"\bto\s?do\b", r"\bin\s+progress\b", r"\bbloqueo[s]?\b")),
    ("browser", (r"https?://", r"\bwww\.", r"\blocalhost\b", r"127\.0\.0\.1", r"\.com\b", r"\.cl\b", r"\bhtml\b", r"\bnavegador\b", r"\blocalhost:\d")),
    ("code", (r"\bimport\s+\w", r"\bdef\s+\w+\s*\(", r"\bfunction\s+\w+\s*\(", r"\bclass\s+\w+", r"</\w+>", r"\bvisual\s+studio\s+code\b", r"\bconsole\b", r"\.py\b", r"\.ts\b", r"\.js\b", r"\.java\b", r"\.json\b", r"\.ya?ml\b")),
    ("teams", (r"\bmicrosoft\s+teams\b", r"\bsilenciar\b", r"\blevantar\s+la\s+mano\b", r"\bparticipantes?\b", r"\breacci[oó]n", r"\bcompartir\s+contenido\b")),
)
DOCUMENT_ARTIFACTS = ("excel", "word", "powerpoint", "jira_planner", "browser", "code")
ARTIFACT_WEIGHTS = {"browser": 8.0, "jira_planner": 8.0, "code": 6.0, "excel": 5.0, "powerpoint": 3.0, "word": 2.5, "teams": 0.2, "otro": 0.8}
ARTIFACT_BONUS = {"browser": 1.0, "code": 1.0, "jira_planner": 0.8, "excel": 0.8, "word": 0.4, "powerpoint": 0.4, "otro": 0.2}
ARTIFACT_SPOKEN = {"browser": "la aplicación web", "code": "el editor de código", "jira_planner": "el tablero de gestión", "excel": "la planilla", "word": "el documento", "powerpoint": "la presentación", "teams": "", "otro": ""}
ACTIONS = (
    ("filtrar", (r"\bfiltr", r"\bfilter", r"\bbuscar\b", r"\bsearch\b", r"\bcriterio", r"\bordenar\b")),
    ("catalogo", (r"\bcat[aá]logo\b", r"\bcatalog\b", r"\blistado\b", r"\bresultados?\b", r"\bapis?\b.*\blista", r"\bexplorar\b")),
    ("formulario", (r"\bformulario\b", r"\bcampo[s]?\b", r"\bnombre\b.*\bdescripci[oó]n\b", r"\brequerido\b", r"\bobligatorio\b", r"\bingres", r"\bcompletar\b")),
    ("crear", (r"\bcrear\b", r"\bnuevo\b", r"\bnueva\b", r"\bcreate\b", r"\bnew\b", r"\bagregar\b", r"\bañadir\b", r"\badd\b")),
    ("desplegar", (r"\bdeploy\b", r"\bdespliegue\b", r"\bdesplegar\b", r"\bpublicar\b", r"\bbuild\b", r"\bpipeline\b", r"\brelease\b")),
    ("configurar", (r"\bconfigur", r"\bajuste", r"\bsettings?\b", r"\bpar[aá]metro", r"\bopciones?\b", r"\bseguridad\b", r"\bpolicy\b", r"\bautorizaci[oó]n\b")),
    ("documentar", (r"\bdocumentaci[oó]n\b", r"\bdocs?\b", r"\bswagger\b", r"\bopen\s?api\b", r"\bespecificaci[oó]n\b", r"\breadme\b")),
    ("validar", (r"\bvalidar\b", r"\bvalidaci[oó]n\b", r"\berror(es)?\b", r"\bok\b", r"\b[eé]xito\b", r"\bcorrecto\b", r"\bprueba\b", r"\btest\b", r"\bresultado\b")),
    ("codigo", (r"\bimport\s+\w", r"\bdef\s+\w+\s*\(", r"\bfunction\s+\w+", r"\bclass\s+\w+", r"</\w+>", r"\.ya?ml\b", r"\.json\b", r"\brepositorio\b", r"\bcommit\b")),
    ("navegar", (r"\bmen[uú]\b", r"\binicio\b", r"\bhome\b", r"\bsecci[oó]n\b", r"\bpesta[ñn]a\b", r"\bvolver\b", r"\bsiguiente\b", r"\bnext\b")),
)
ACTION_PHRASES = {
    "filtrar": ("se aplican los filtros para acotar el resultado", "se ajustan los criterios de búsqueda", "se refina la selección con los filtros disponibles"),
    "catalogo": ("se consulta el catálogo y se revisa el listado disponible", "se recorre el listado del catálogo", "se ubica el elemento dentro del catálogo"),
    "formulario": ("se completan los campos del formulario con los datos del caso", "se cargan los datos requeridos en el formulario", "se termina de completar la información solicitada"),
    "crear": ("se crea el nuevo elemento desde la opción correspondiente", "se da de alta el nuevo registro", "se genera el elemento con los datos ya definidos"),
    "desplegar": ("se ejecuta el despliegue de la aplicación", "se lanza el proceso de publicación", "se pone en marcha el despliegue"),
    "configurar": ("se ajustan los parámetros de configuración", "se define la configuración correspondiente", "se completan las opciones necesarias"),
    "documentar": ("se revisa la documentación generada", "se contrasta el resultado con la documentación", "se verifica la especificación publicada"),
    "validar": ("se valida que el resultado obtenido sea el esperado", "se comprueba el resultado de la ejecución", "se confirma que la respuesta es correcta"),
    "codigo": ("se revisa el código del componente", "se inspecciona la implementación", "se recorre el detalle del código"),
    "navegar": ("se accede a la sección correspondiente", "se avanza hasta la siguiente sección", "se abre la opción indicada"),
    "escribir": ("se ingresan los datos del ejemplo, campo por campo", "se escribe el detalle solicitado", "se completa la información del caso"),
    "interactuar": ("se recorren y seleccionan las opciones", "se marcan las opciones necesarias", "se navega por las alternativas disponibles"),
    "cambiar": ("se avanza a la siguiente pantalla del proceso", "se pasa a la vista siguiente"),
    "revisar": ("se revisa el detalle desplegado", "se observa el resultado en pantalla"),
}
ACTION_CAPTIONS = {
    "filtrar": "aplicar filtros", "catalogo": "revisar el catálogo", "formulario": "completar el formulario", "crear": "crear el elemento",
    "desplegar": "desplegar", "configurar": "configurar", "documentar": "revisar documentación", "validar": "validar el resultado",
    "codigo": "revisar el código", "navegar": "navegar a la sección", "escribir": "ingresar los datos", "cambiar": "cambiar de pantalla",
    "interactuar": "recorrer y seleccionar", "revisar": "revisar la pantalla",
}
CONNECTORS = (
    "Para comenzar", "A continuación", "Luego", "Enseguida", "Después", "Más adelante", "En el siguiente paso", "Posteriormente",
    "Acto seguido", "Hecho esto", "Ya con eso resuelto", "Siguiendo el flujo", "En esta etapa", "Una vez confirmado", "Con la información cargada",
)
LAST_CONNECTOR, LATER_CONNECTOR = "Para cerrar el procedimiento", "Después"
VALUE_CUES = (
    (r"\bjira\b", 4.0),
    (r"historia[s]?\s+de\s+usuario|\bh\.?\s?d\.?\s?u\.?\b|\bhu[-\s]?\d", 4.0),
    (r"\bbacklog\b|\bsprint\b|\b[eé]pica\b|story\s*points?", 2.5),
    (r"cascad[ae]|waterfall", 3.0),
    (r"visualizador|visualiza", 4.0),
    (r"lenguaje\s+natural|\bprompt\b|\bcomando\b", 3.5),
    (r"open\s?api|spectral|swagger|endpoint", 2.5),
    (r"\bagente[s]?\b|ag[eé]ntic|\bdevin\b|\bcopilot\b", 0.8),
    (r"\bflujo\b|pipeline|workflow", 0.5),
)
CANONICAL_TOPICS = (
    ("CI/CD", ("cicd", "ci-cd", "ci/cd", "pipeline")),
    ("QA / Pruebas", ("qa", "certificacion", "prueba", "pruebas")),
    ("Jira / HDU", ("jira", "hdu", "flujo-jira", "historia")),
    ("Agente / Framework (concepto)", ("concepto", "framework", "agente", "agentico", "que-es")),
    ("Codigo / PR", ("codigo", "pr", "commit", "repositorio")),
    ("API / Mesa", ("mesa", "api", "mesadeapi")),
    ("Visualizador / Front (Digital Host)", ("visualizador", "digital-host", "digital host", "front")),
    ("MCP / Integracion", ("mcp", "integracion")),
)
UNCLASSIFIED = "(sin clasificar)"
THEMES = (
    ("Que-es-un-Agente", "¿Qué es un agente?", 0, (), (r"\bagente[s]?\b", r"ag[eé]ntic", r"\bdevin\b", r"\bcopilot\b", r"framework", r"c[eé]lula")),
    ("Panel-Cascade", "El panel Cascade", 1, ("code", "browser"), (r"cascad[ae]", r"waterfall", r"\bplan(?:ificaci[oó]n|ner)?\b", r"paso a paso", r"\bflujo\b", r"pipeline", r"workflow")),
    ("Visualizador-Agentico", "El visualizador agéntico", 2, ("browser",), (r"visualizador", r"visualiza", r"preview", r"vista previa", r"localhost", r"\bhost\b", r"navegaci[oó]n")),
    ("Jira-HDU-Refinamiento", "Jira, HDU y refinamiento", 3, ("jira_planner",), (r"\bjira\b", r"historia[s]?\s+de\s+usuario", r"\bh\.?\s?d\.?\s?u\.?\b", r"\bhu[-\s]?\d", r"backlog", r"sprint", r"[eé]pica", r"refin", r"story\s*points?", r"planner")),
    ("MCP-Conexion", "MCP: conectar la IA", 4, ("code", "browser"), (r"\bmcp\b", r"model\s+context", r"protocolo\s+de\s+contexto", r"integraci[oó]n", r"conect", r"\bapi\b", r"servidor")),
    ("Auto-aprendizaje-Calibracion", "Auto-aprendizaje y calibración", 5, ("code",), (r"skill", r"guardrail", r"guardarra", r"calibr", r"aprend", r"lenguaje", r"guideline", r"lecci[oó]n", r"regla[s]?", r"entren")),
    ("Software-de-Terceros", "Integración con terceros", 6, ("excel", "browser", "code"), (r"third[-\s]?party", r"terceros", r"external", r"externo", r"excel", r"power\s?bi", r"postman", r"swagger", r"open\s?api", r"spectral", r"figma", r"sonar", r"trivy", r"xray")),
)
ACT_LABELS = ("¿Qué hace?", "¿Para qué sirve?", "¿Cuál es el resultado?")
UI_CHROME = (
    "chat", "chats", "sessions", "session", "about", "acerca", "notas", "resumen", "compartida", "compartido",
    "compartir", "participantes", "participante", "reunion", "reunión", "grabacion", "grabación", "transcripcion",
    "transcripción", "pregunta", "preguntas", "pregun", "respuesta", "respuestas", "mensaje", "mensajes", "teams",
    "meet", "zoom", "copilot", "menu", "menú", "opciones", "configuracion", "configuración", "ayuda", "archivo",
    "editar", "ver", "inicio", "home", "file", "edit", "view", "help", "search", "buscar", "settings", "more", "mas",
    "más", "calendario", "calendar", "actividad", "activity", "aplicaciones", "apps", "camara", "cámara", "microfono",
    "micrófono", "silenciar", "salir", "finalizar",
)
VOICES = {
    "mx": "es-MX-DaliaNeural", "mx-f": "es-MX-DaliaNeural", "mx-m": "es-MX-JorgeNeural", "co": "es-CO-SalomeNeural", "co-m": "es-CO-GonzaloNeural",
    "ar": "es-AR-ElenaNeural", "ar-m": "es-AR-TomasNeural", "cl": "es-CL-CatalinaNeural", "cl-m": "es-CL-LorenzoNeural", "us": "es-US-PalomaNeural", "us-m": "es-US-AlonsoNeural",
}
DEFAULT_VOICE = "es-MX-DaliaNeural"
# End of the fixed values.


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern with Unicode classes and boundaries, and Unicode case folding."""
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def needed(pattern: str) -> tuple[str, ...]:
    """Literals of which every match of a pattern of lower case holds one at least; empty if there is no telling.

    Searching for them is many times faster than a Unicode-aware regular expression, which then runs where one occurs.
    """

    def runs(parts) -> tuple[str, ...]:
        best, run = (), ""
        for op, arg in [*parts, (None, None)]:
            if op is constants.LITERAL and chr(arg) != "ſ":
                run += chr(arg)
                continue
            if len(run) > min(map(len, best), default=0):
                best = (run,)
            run, inner = "", ()
            if op is constants.SUBPATTERN:
                inner = runs(arg[3])
            elif op is constants.BRANCH:
                each = [runs(x) for x in arg[1]]
                inner = tuple(w for x in each for w in x) if all(each) else ()
            elif op is constants.MAX_REPEAT and arg[0] > 0:
                inner = runs(arg[2])
            if inner and min(map(len, inner)) > min(map(len, best), default=0):
                best = inner
        return best

    return tuple(dict.fromkeys(runs(parser.parse(pattern))))


def folded(text: Column) -> Column:
    """Lower case, and what else a pattern that ignores case takes for a plain letter as that letter."""
    return F.lower(F.translate(text, "ſıİ", "sii"))  # in this order, as lower makes two signs of the last


def may_match(low: Column, pattern: str) -> Column:
    """False only where the folded text can't match the pattern."""
    words = needed(pattern)
    out = F.lit(True) if not words else low.contains(words[0])
    for word in words[1:]:
        out = out | low.contains(word)
    return out


_EDGE = r"[^\p{L}\p{N}_]"


def re2(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for DuckDB: its boundaries know ASCII only, so they're spelt out; for yes-or-no tests."""
    out = re.sub(r"\\b(?=[\w(\[\\])", lambda _: rf"(?:^|{_EDGE})", pattern.replace(r"\w", r"[\p{L}\p{N}_]"))
    out = out.replace(r"\b", rf"(?:{_EDGE}|$)")
    return ("(?is)" if ignore_case else "(?s)") + out


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def matches(text: Column, pattern: str, low: Column | None = None) -> Column:
    """Whether a pattern occurs; with the folded text, the pattern runs only where it may."""
    hit = text.rlike(java(pattern))
    return F.coalesce(hit if low is None else may_match(low, pattern) & hit, F.lit(False))


def once(make, *columns: Column) -> Column:
    """``make`` of the columns, each of which is evaluated once a row, however often its result is used."""
    row = F.struct(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    return F.transform(F.array(row), lambda x: make(*[x[f"c{i}"] for i in range(len(columns))]))[0]


def first_match(conditions: list[tuple[Column, str]], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    out = otherwise
    for condition, value in reversed(conditions):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def topics_of(text: Column, topics=TOPICS) -> Column:
    """Names of the topics whose pattern occurs, in the order of the rules."""
    return once(lambda t, low: F.array_compact(F.array(*[F.when(matches(t, p, low), F.lit(n)) for n, p in topics])), text, folded(text))


def is_intent(text: Column, pattern: str = INTENT) -> Column:
    return matches(text, pattern)


def is_question(text: Column) -> Column:
    """A question mark, and three words or more."""
    return F.coalesce(text.rlike(r"[?¿]") & (F.size(F.split(F.trim(text), r"\s+")) >= 3), F.lit(False))


def grid_lines(text: Column) -> Column:
    """Lines that are made of figures, signs and separators, with a figure."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\R")
    return F.size(F.filter(lines, lambda x: F.trim(x).rlike(r"^[$\-+()\d.,%\s/:]+$") & x.rlike(r"\d")))


def artifact_of(text: Column, signals=ARTIFACT_SIGNALS, most: int = 8) -> Column:
    """Struct of class, cues, score: distinct matched tokens a class, a bonus for grids; the earlier class wins ties.

    Every pattern is applied once at most, where its literals occur: the classes are compared as structs of score and
    rank. Select its fields in a projection of their own.
    """
    return once(lambda low, grid: _artifact(low, grid, signals, most), F.lower(F.coalesce(text, F.lit(""))), grid_lines(text))


def _artifact(low: Column, grid: Column, signals, most: int) -> Column:
    token = lambda p: F.when(may_match(low, p), F.trim(F.regexp_extract(low, "(?sU)" + p.replace(".*", r"[^\n]*"), 0))).otherwise("")
    found = F.array(*[F.array_distinct(F.filter(F.array(*map(token, patterns)), lambda x: x != "")) for _, patterns in signals])
    names = [n for n, _ in signals]
    bonus = F.when(grid >= 4, F.least(F.floor(grid / 3).cast("int"), F.lit(4))).otherwise(F.lit(0))
    note = F.when(grid >= 4, F.array(F.concat(F.lit("grilla numérica (~"), grid.cast("string"), F.lit(" líneas)")))).otherwise(F.array().cast("array<string>"))
    sheet = names.index("excel") if "excel" in names else -1
    scored = F.transform(
        found,
        lambda c, i: F.struct(
            (F.size(c) + F.when(i == sheet, bonus).otherwise(F.lit(0))).alias("score"), (-i).alias("rank"),
            F.when(i == sheet, F.concat(c, note)).otherwise(c).alias("cues"),
        ),
    )
    return once(
        lambda b: F.struct(
            F.when(b["score"] > 0, F.element_at(F.array(*map(F.lit, names)), 1 - b["rank"])).otherwise("otro").alias("artifact"),
            F.when(b["score"] > 0, F.slice(b["cues"], 1, most)).otherwise(F.array().cast("array<string>")).alias("cues"),
            b["score"].alias("score"),
        ),
        F.array_max(scored),
    )


def action_of(text: Column, change: Column, activity: Column, actions=ACTIONS) -> Column:
    """The first action whose pattern occurs; without one, by movement on the screen."""
    moved = F.when(change >= 25.0, "cambiar").when((activity >= 0.35) | (change >= 6.0), "escribir").when(activity >= 0.15, "interactuar").otherwise("revisar")
    any_of = lambda low, ps: functools.reduce(Column.__or__, [may_match(low, p) & low.rlike("(?U)" + p) for p in ps])
    return once(lambda low, other: first_match([(any_of(low, p), n) for n, p in actions], other), F.lower(F.coalesce(text, F.lit(""))), moved)


def value_score(text: Column, cues=VALUE_CUES) -> Column:
    """Sum of the weights of the cues that occur."""
    return once(lambda t, low: sum((F.when(matches(t, p, low), F.lit(w)).otherwise(F.lit(0.0)) for p, w in cues), F.lit(0.0)), text, folded(text))


def theme_scores(text: Column, artifact: Column, value: Column, themes) -> Column:
    """Array of (slug, score) of the themes with a cue: two for each cue, 1.5 for the artifact, a fifth of the value."""

    def scored(theme, t: Column, low: Column) -> Column:
        slug, _, _, artifacts, cues = theme
        hits = sum((F.when(matches(t, p, low), F.lit(1)).otherwise(F.lit(0)) for p in cues), F.lit(0))
        more = F.when(artifact.isin(*artifacts) if artifacts else F.lit(False), F.lit(1.5)).otherwise(F.lit(0.0)) + 0.2 * value
        return once(lambda n: F.when(n > 0, F.struct(F.lit(slug).alias("slug"), (2.0 * n + more).alias("score"))), hits)

    return once(lambda t, low: F.array_compact(F.array(*[scored(theme, t, low) for theme in themes])), text, folded(text))


def canonical_topic(text: Column, rules=CANONICAL_TOPICS) -> Column:
    """The first topic with one of its first two keywords in the text, or else the last topic with any; else null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    any_of = lambda words: F.coalesce(*[F.when(low.contains(w), F.lit(True)) for w in words], F.lit(False))
    sure = [(any_of(words[:2]), name) for name, words in rules]
    loose = [(any_of(words), name) for name, words in reversed(rules)]
    return first_match(sure, first_match(loose, F.lit(None).cast("string")))


def lookup(key: Column, table: dict, default) -> Column:
    """The value of a key in a small constant table."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def action_phrase(action: Column, repeat: Column, fallback: Column | None = None) -> Column:
    """The phrase of an action; its variants take turns."""
    out = fallback if fallback is not None else F.lit("")
    for name, phrases in ACTION_PHRASES.items():
        turn = F.element_at(F.array(*map(F.lit, phrases)), F.pmod(repeat, F.lit(len(phrases))).cast("int") + 1)
        out = F.when(action == name, turn).otherwise(out)
    return out


def step_clause(action: Column, screen: Column, artifact: Column, repeat: Column) -> Column:
    """What a step does, and where: on its screen, or else on its artifact."""
    phrase, where = action_phrase(action, repeat), lookup(artifact, ARTIFACT_SPOKEN, "")
    place = F.when(F.coalesce(screen, F.lit("")) != "", screen).when(where != "", where)
    return F.when(place.isNotNull(), F.concat(phrase, F.lit(" en "), place)).otherwise(phrase)


def voice_of(alias: Column) -> Column:
    """The voice of an alias; an unknown alias is a voice of its own, and none is the default."""
    low = F.lower(F.coalesce(alias, F.lit("")))
    known = lookup(low, VOICES, "")
    return F.when(known != "", known).when(low != "", alias).otherwise(F.lit(DEFAULT_VOICE))


def act_caption(act: Column, title: Column) -> Column:
    label = F.element_at(F.array(*map(F.lit, ACT_LABELS)), F.greatest(F.lit(0), F.least(F.lit(2), act)).cast("int") + 1)
    return F.concat(label, F.lit(" · "), title)
