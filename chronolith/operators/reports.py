"""Compositions: use cases of a recording, walkthroughs, quotes, coverage reports, the reprocessing gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import clock, rules
from chronolith.functions import text as T

from . import entities, select, timeline, topics

GENERIC_ACTIONS = ("revisar", "interactuar", "cambiar")

# How topics are spoken of (name, what is done, what it is worth).
TOPIC_PROFILES = (
    ("Visualizador / Front", "la construcción de la interfaz de usuario", "el equipo construye y revisa la capa visual con la que interactúa el usuario final", "acorta el tiempo entre una definición funcional y una pantalla operativa que el negocio puede validar"),
    ("API / Mesa", "la construcción y publicación de servicios", "el equipo define, construye y publica los servicios que exponen la funcionalidad al resto de la organización", "asegura que cada servicio quede documentado, estandarizado y disponible para ser reutilizado"),
    ("MCP / Integración", "la integración entre sistemas", "el equipo conecta los distintos componentes para que la información fluya de extremo a extremo", "evita el trabajo manual entre plataformas y reduce los puntos de falla de la operación"),
    ("CI/CD", "la integración y el despliegue continuo", "el equipo automatiza la construcción y la puesta en marcha de la aplicación", "permite liberar cambios de forma frecuente, controlada y con trazabilidad"),
    ("QA / Pruebas", "el aseguramiento de la calidad", "el equipo verifica el comportamiento de la solución antes de ponerla en producción", "reduce los incidentes en producción y protege la experiencia del cliente"),
    ("Jira / HDU", "la gestión del trabajo y las historias de usuario", "el equipo organiza y refina el trabajo pendiente con trazabilidad", "da visibilidad del avance real y previsibilidad a los compromisos"),
    ("Código / PR", "el desarrollo y la revisión del código", "el equipo escribe el código y lo somete a revisión antes de integrarlo", "mantiene la calidad técnica y el control sobre lo que llega al producto"),
    ("Agente / Framework", "el uso del framework agéntico", "el equipo apoya su trabajo en agentes que ejecutan tareas bajo su supervisión", "amplifica la capacidad del equipo sin ceder el control de las decisiones"),
)


# How a topic without a profile is spoken of, and the sentences about any topic around its parts.
OTHER_DONE = ("el equipo trabaja sobre ", " dentro del proceso de desarrollo")
OTHER_WORTH = "aporta orden y trazabilidad al trabajo del equipo"
TOPIC_INTRO = ("En esta cápsula revisamos ", ". Durante la sesión, ", ". Veamos el procedimiento en pantalla, tal como fue ejecutado.")
TOPIC_CLOSE = ("El procedimiento queda documentado y puede repetirse cuando se necesite. Para la organización, ", ".")


def topic_profile(topic: Column) -> Column:
    """Struct of name, done and worth of a topic; a neutral one of an unknown topic."""
    bare = F.lower(F.trim(F.regexp_replace(topic, r"\s*/\s*", " y ")))
    out = F.struct(bare.alias("name"), F.concat(F.lit(OTHER_DONE[0]), bare, F.lit(OTHER_DONE[1])).alias("done"), F.lit(OTHER_WORTH).alias("worth"))
    for name, *parts in TOPIC_PROFILES:
        out = F.when(topic == name, F.struct(*[F.lit(p).alias(n) for p, n in zip(parts, ("name", "done", "worth"), strict=True)])).otherwise(out)
    return out


# What the script of a catalogue theme says about its parts, in order, and how it ends.
THEME_OPENING = "Cápsula."
THEME_CONTEXT = "Veamos primero el contexto."
THEME_ASKS = "La pregunta que suele surgir es esta:"
THEME_ANSWERS = "Y la respuesta, en simple, es la siguiente."
THEME_EXAMPLE = "Mirémoslo con un ejemplo bien sencillo, a prueba de niños."
THEME_RESULT = "Entonces, ¿cuál es el resultado?"
THEME_WORTH = "¿Y qué significa esto para el banco?"
THEME_CLOSE = (
    "En resumen: el Framework Agéntico no reemplaza a las personas, amplifica lo que saben hacer. "
    "La inteligencia artificial ejecuta; las personas deciden. Gracias por acompañarme en esta Cápsula."
)
THEME_QUESTION = ("¿Cómo funciona ", " y qué gano con esto?")


def theme_script(title: Column, hook: Column, what: Column, purpose: Column, result: Column, question: Column, example: Column, worth: Column) -> Column:
    """The spoken text about a catalogue theme. Null and empty parts are left out; without an example or a worth their
    headings go too, and without a question one is made of the title."""
    filled = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    under = lambda head, c: F.when(filled(c).isNotNull(), F.concat(F.lit(head), F.lit(" "), c))
    asked = F.coalesce(filled(question), F.concat(F.lit(THEME_QUESTION[0]), F.lower(F.coalesce(title, F.lit(""))), F.lit(THEME_QUESTION[1])))
    return F.concat_ws(
        " ", F.lit(THEME_OPENING), filled(hook), F.lit(THEME_CONTEXT), filled(what), F.lit(THEME_ASKS), asked, F.lit(THEME_ANSWERS), filled(purpose),
        under(THEME_EXAMPLE, example), F.lit(THEME_RESULT), filled(result), under(THEME_WORTH, worth), F.lit(THEME_CLOSE),
    )


def grounded_script(topic: Column, walkthrough: Column | None = None) -> Column:
    """The spoken text about a topic, a walkthrough in its middle if there is one."""
    p = topic_profile(topic)
    intro = F.concat(F.lit(TOPIC_INTRO[0]), p["name"], F.lit(TOPIC_INTRO[1]), p["done"], F.lit(TOPIC_INTRO[2]))
    close = F.concat(F.lit(TOPIC_CLOSE[0]), p["worth"], F.lit(TOPIC_CLOSE[1]))
    middle = F.nullif(F.coalesce(walkthrough if walkthrough is not None else F.lit(""), F.lit("")), F.lit(""))
    return F.concat_ws(" ", intro, middle, close)


def step_caption(index: Column, screen: Column, action: Column, most: int = 64) -> Column:
    """``Paso N · screen · what is done``, cut off with an ellipsis."""
    done = rules.lookup(action, rules.ACTION_CAPTIONS, "")
    whole = F.concat_ws(" · ", F.concat(F.lit("Paso "), index.cast("string")), F.nullif(F.coalesce(screen, F.lit("")), F.lit("")), F.nullif(F.when(done != "", done).otherwise(F.coalesce(action, F.lit(""))), F.lit("")))
    cut = F.regexp_replace(F.substring(whole, 1, most - 1), r"[ ·]+$", "")
    return F.when(F.length(whole) > most, F.concat(cut, F.lit("…"))).otherwise(whole)


def item_seconds(base: Column, narration: Column, pad: float = 0.4) -> Column:
    """How long an item lasts: its own time, or its narration and a pause."""
    return F.greatest(base, F.when(F.coalesce(narration, F.lit(0.0)) > 0, narration + pad).otherwise(F.lit(0.0)))


def walkthrough_steps(steps: DataFrame, track: list[str], most: int = 16, per_action: int = 4) -> DataFrame:
    """Steps that a walkthrough tells, numbered: columns n (from 0), last, clause.

    steps: index, start, action, screen, artifact. Repeats of the step before are left out. Where more than ``most`` are
    left: specific actions only, if they are enough, ``per_action`` of each, those with a screen first, and then evenly
    spread ones.
    """
    whole = Window.partitionBy(*track)
    blocks = timeline.without_repeats(steps, track, ["start", "index"], ["action", "screen"])
    specific = ~F.col("action").isin(*GENERIC_ACTIONS)
    blocks = blocks.withColumn("__m", F.count(F.lit(1)).over(whole)).withColumn("__s", F.count_if(specific).over(whole))
    long = F.col("__m") > most
    blocks = blocks.where(~long | (F.col("__s") < max(3, most // 2)) | specific)
    first = F.row_number().over(Window.partitionBy(*track, "action").orderBy(F.when(F.coalesce("screen", F.lit("")) != "", 0).otherwise(1), "start", "index"))
    blocks = blocks.withColumn("__f", first).where(~long | (F.col("__f") <= per_action)).drop("__m", "__s", "__f")
    told = select.even_picks(blocks, track, ["start", "index"], most)
    n = F.row_number().over(whole.orderBy("start", "index")) - 1
    told = told.withColumn("n", n).withColumn("last", F.count(F.lit(1)).over(whole) - 1)
    repeat = timeline.occurrence(track, ["action"], ["start", "index"])
    return told.withColumn("__r", repeat).withColumn("clause", rules.step_clause(F.col("action"), F.col("screen"), F.col("artifact"), F.col("__r"))).drop("__r")


def case_quotes(cases: DataFrame, segments: DataFrame, track: list[str], most: int = 6, words: int = 4, bin_seconds: float = 60.0) -> DataFrame:
    """The longest distinct texts within ``[start - 1, end]`` of each case: track, topic, place (from 1), text."""
    c = cases.select(*track, "topic", F.col("start").alias("lo"), F.col("end").alias("hi"))
    said = segments.select(*track, F.col("start").alias("at"), "ord", "text").where(F.size(T.words(F.col("text"))) >= words)
    pairs = timeline.within(said, c, track, "at", "lo", "hi", 1.0, bin_seconds).where((F.col("at") >= F.col("lo") - 1) & (F.col("at") <= F.col("hi")))
    each = pairs.groupBy(*track, "topic", "text").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy(*track, "topic").orderBy(F.length("text").desc(), "ord"))
    return each.withColumn("place", place).where(F.col("place") <= most).select(*track, "topic", "place", F.trim("text").alias("text"))


def grounded_use_cases(cases: DataFrame, moments: DataFrame, track: list[str], *, least: int = 2, marks: int = 18, most: int = 6, slack: float = 5.0, bin_seconds: float = 60.0) -> DataFrame:
    """Marks of a recording's first ``most`` cases with mentions enough: even picks of the screen moments about each.

    moments: ts, ord, artifact, skin. Where no screen moment is near a case, any moment without people serves; a case
    without those is left out.
    """
    w = Window.partitionBy(*track).orderBy("start", "topic")
    strong = cases.where(F.col("mentions") >= least).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    strong = strong.select(*track, "topic", "place", F.col("start").alias("lo"), F.col("end").alias("hi"))
    pool = topics.screen_pool(moments, track).select(*track, "ord", F.lit(True).alias("screen"))
    clean = moments.where(~topics.has_people()).select(*track, "ord", "ts").join(pool, [*track, "ord"], "left")
    near = timeline.within(clean, strong, track, "ts", "lo", "hi", slack, bin_seconds)
    any_screen = F.max(F.col("screen").isNotNull().cast("int")).over(Window.partitionBy(*track, "topic"))
    near = near.withColumn("__any", any_screen).where((F.col("__any") == 0) | F.col("screen")).drop("__any", "screen")
    return select.even_picks(near, [*track, "topic"], ["ts", "ord"], marks).select(*track, "topic", "place", "lo", "hi", "ts", "ord")


def discovered_use_cases(moments: DataFrame, lengths: DataFrame, track: list[str], themes=rules.THEMES, *, least: int = 3, marks: int = 14, most: int = 8, span: float = 15.0) -> DataFrame:
    """Use cases by the catalogue of themes: track, slug, place, start, end. The first theme, the introduction, is always
    there and spans the whole; the others come in the order of their first moment, as far as ``most`` go, each with two
    moments or more, a gap apart, over ``span`` seconds.

    moments: ts, ord, ocr_text, artifact, skin, value; lengths: length. The gap is a 60th of the length, 6 to 20 s.
    """
    clean = moments.where(~topics.has_people())
    found = topics.present_themes(clean, track, "ts", "ocr_text", "artifact", "value", themes[1:], least)
    found = found.join(lengths, track).withColumn("gap", F.greatest(F.lit(6.0), F.least(F.lit(20.0), F.col("length") / 60.0)))
    place = F.row_number().over(Window.partitionBy(*track).orderBy("start", "slug"))
    found = found.withColumn("place", place).where(F.col("place") <= most - 1)
    enough = (F.col("end") - F.col("start") >= span) & (F.col("end") - F.col("start") >= F.col("gap"))
    rest = found.where(enough).select(*track, "slug", F.col("place").cast("int").alias("place"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    intro = lengths.select(*track, F.lit(themes[0][0]).alias("slug"), F.lit(0).alias("place"), F.lit(0.0).alias("start"), F.col("length").cast("double").alias("end"))
    return intro.unionByName(rest)


def discovery_matrix(cases: DataFrame, track: list[str]) -> DataFrame:
    """A row for each topic of a track: clock of its interval, mentions, whether it has a question and an intent."""
    return cases.select(*track, "topic", clock.clock(F.col("start")).alias("from"), clock.clock(F.col("end")).alias("to"), "mentions", (F.col("question") != "").alias("asked"), (F.col("intent") != "").alias("intended"))


def temporal_map(tagged: DataFrame, moments: DataFrame, track: list[str]) -> DataFrame:
    """Segments with an intent, a question or a topic, and the artifact on the screen nearest to each; ``-`` without one.

    moments: ts, ord, artifact.
    """
    telling = tagged.where(F.col("intent") | F.col("question") | (F.size("topics") > 0))
    seen = timeline.nearest(telling, moments.withColumnRenamed("ord", "__mo"), track, "start", "ts", "__mo", ["artifact"])
    return seen.withColumn("artifact", F.coalesce("artifact", F.lit("-")))


def open_cases(videos: DataFrame, folders: DataFrame, found: DataFrame, outputs: DataFrame) -> DataFrame:
    """Cases of each video by the discovery folder its name matches best, and whether they are new: video, topic, focus ...

    videos: video; folders: folder; found: folder, ord, topic, interval, mentions; outputs: output, topic, slug, ord.
    """
    matched = entities.token_match(videos, folders, "video", "video", "folder", "folder").select("video", "folder")
    named = found.join(matched, "folder").withColumn("topic", F.coalesce(rules.canonical_topic(F.col("topic")), "topic"))
    covered = topics.covered_topics(outputs, "ord").select("topic", F.lit(True).alias("covered"))
    out = named.join(covered, "topic", "left").withColumn("minutes", clock.span_minutes(F.col("interval")))
    return out.withColumn("focus", topics.focus_of(F.col("mentions"), F.col("minutes"), F.coalesce("covered", F.lit(False)))).select("video", "folder", "topic", "interval", "mentions", "minutes", "focus")


def video_report(videos: DataFrame, cases: DataFrame, claims: DataFrame, outputs: DataFrame) -> DataFrame:
    """Each video's objective, outputs and new cases; whether it is processed and has nothing new.

    videos: video; cases: of open_cases; claims: video, output; outputs: output, topic.
    """
    seen = cases.groupBy("video").agg(F.collect_set("topic").alias("a"), F.array_sort(F.collect_set(F.when(F.col("focus") == "new", F.col("topic")))).alias("new_cases"), F.lit(True).alias("found"))
    made = claims.join(outputs.select("output", "topic"), "output", "left").groupBy("video").agg(F.collect_set("topic").alias("b"), F.array_sort(F.collect_set("output")).alias("outputs"))
    none = F.array().cast("array<string>")
    out = videos.join(seen, "video", "left").join(made, "video", "left")
    out = out.withColumn("objective", F.array_sort(F.array_union(F.coalesce("a", none), F.coalesce("b", none))))
    processed = F.coalesce("found", F.lit(False)) | (F.size(F.coalesce("outputs", none)) > 0)
    out = out.withColumn("new_cases", F.coalesce("new_cases", none)).withColumn("outputs", F.coalesce("outputs", none)).withColumn("processed", processed)
    return out.select("video", "objective", "outputs", "new_cases", "processed", (F.col("processed") & (F.size("new_cases") == 0)).alias("nothing_new"))


def may_process(identities: DataFrame, claims: DataFrame, force: bool = False) -> DataFrame:
    """Adds ``process``: false for an exact duplicate of a video that has outputs, unless forced. identities: match, status."""
    have = claims.select(F.col("video").alias("match"), F.lit(True).alias("has")).distinct()
    out = identities.join(have, "match", "left")
    stop = (F.col("status") == "EXACT_DUPLICATE") & F.coalesce("has", F.lit(False))
    return out.withColumn("process", F.lit(force) | ~stop).drop("has")


def history(audit: DataFrame, entity: str | None = None) -> DataFrame:
    return audit if entity is None else audit.where(F.col("entity") == entity)


def added_use_cases(candidates: DataFrame, matches: DataFrame, store: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates that become new use cases, with ids; evidence for existing ones): by the status of their match.

    DUPLICATE and EXISTING candidates are evidence of their match unless forced; NEW and RELATED ones are created.
    """
    both = candidates.join(matches.select("cand_id", "status", F.col("use_case_id").alias("match")), "cand_id", "left")
    known = F.col("status").isin("DUPLICATE", "EXISTING") & F.lit(not force)
    fresh = entities.next_ids(both.where(~F.coalesce(known, F.lit(False))).drop("match"), store, "use_case_id", "UC", ["cand_id"])
    return fresh, both.where(known).withColumn("use_case_id", F.col("match")).drop("match")
