"""The next action of a goal-directed crawl, from recorded screens and candidates, and whether a goal is reached."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..functions.urls import part

#: The steps towards each goal phrase as (keyword, route on which the step is done, whether a prefix of it counts, path to go to).
SIGN_IN = [("sign in", "/user/login", False, None), ("user_name", None, False, None), ("password", None, False, None), ("sign in", None, False, None)]
RECIPES = {
    "sign in": SIGN_IN,
    "create a new issue": [
        ("demo/demo-repo", "/{owner}/{repo}", True, None), ("new issue", "/{owner}/{repo}/issues/new", False, None), ("title", None, False, None),
        ("content", None, False, None), ("create issue", None, False, None),
    ],
    "subscribe": [("", None, False, "/demo/demo-repo/issues/1"), ("subscribe", None, False, None), ("watch", None, False, None)],
}
#: Keywords of fields, of buttons, and those that must not meet their opposite.
FIELDS, BUTTONS, NOT_UN = ("user_name", "password", "title", "content"), ("submit", "create issue", "sign in"), ("subscribe", "watch")
LOGIN = "/user/login"
#: Ranks of what comes after a recipe's own steps.
DETOUR, ANY_LINK = 1_000, 2_000
STEP = "array<struct<no:int,keyword:string,done_on:string,prefix:boolean,go:string>>"


def _steps(steps: list[tuple], first: int = 0) -> Column:
    return F.array(*(F.struct(F.lit(first + i), *map(F.lit, s)) for i, s in enumerate(steps))).cast(STEP)


def recipe(goal: Column, recipes: dict[str, list[tuple]], route: Column) -> Column:
    """The steps for a goal: those of the first phrase in it, and on the login page those of signing in after them."""
    g, none = F.lower(goal), F.array().cast(STEP)
    own, signs_in = none, F.lit(False)
    if "subscribe" in recipes:
        own, signs_in = F.when(g.contains("watch"), _steps(recipes["subscribe"])).otherwise(none), g.contains("watch") & F.lit(recipes["subscribe"] == SIGN_IN)
    for phrase, steps in reversed(recipes.items()):
        own, signs_in = F.when(g.contains(phrase), _steps(steps)).otherwise(own), F.when(g.contains(phrase), F.lit(steps == SIGN_IN)).otherwise(signs_in)
    return F.concat(own, F.when((route == LOGIN) & ~F.coalesce(signs_in, F.lit(False)), _steps(SIGN_IN, DETOUR)).otherwise(none))


def decide(states: DataFrame, candidates: DataFrame, recipes: dict[str, list[tuple]] = RECIPES) -> DataFrame:
    """(state, element_id, action, rationale, source, fill_value_key, navigate_to) of states (state, goal, url, route_pattern).

    Candidates are (state, ord, element_id, role, name, href, action, reason_blocked, fill_value_key). The first step that is
    not done and has a candidate, or a path to go to, decides; else the first link; else it is `stop`. A null goal has no
    recipe; a null name or href contains no keyword.
    """
    todo = states.select("state", F.coalesce("route_pattern", F.lit("")).alias("route"), F.coalesce(F.nullif(part(F.col("url"), 5), F.lit("")), F.lit("/")).alias("path"), F.explode(recipe(F.coalesce("goal", F.lit("")), recipes, F.coalesce("route_pattern", F.lit("")))).alias("s")).select("state", "route", "path", "s.*")
    done = F.when(F.col("go").isNotNull(), F.col("path") == F.col("go")).when(F.col("done_on").isNull(), False).when(F.col("prefix"), F.col("route").startswith(F.col("done_on"))).otherwise(F.col("route") == F.col("done_on"))
    todo = todo.where(~done)

    able = candidates.where("reason_blocked is null").select("state", "ord", "element_id", "role", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("href", F.lit("")).alias("href"), "action", "fill_value_key")
    pick = lambda no, rank, why, go: F.struct(no.alias("no"), *(r.cast("int").alias(f"r{i}") for i, r in enumerate(rank)), F.col("ord").cast("long").alias("ord"), "element_id", F.col("action"), why.alias("rationale"), "fill_value_key", go.cast("string").alias("go"))
    word, none, zero = F.col("keyword"), F.lit(None), F.lit(0)
    met = (F.lower("name").contains(word) | F.lower("href").contains(word)) & ~(word.isin(*NOT_UN) & F.lower("name").startswith("un"))
    button = (F.lower("role") == "button") | (F.col("action") == "submit")
    rank = [fold(F.col("name")) != fold(word), F.when(word.isin(*BUTTONS), ~button).otherwise(False), F.when(word.isin(*FIELDS), F.col("action") != "fill").otherwise(~F.col("action").isin("click", "submit"))]
    matched = todo.where("go is null").join(able, "state").where(met).select("state", pick(F.col("no"), rank, F.concat(F.lit("recipe keyword '"), word, F.lit("' matched candidate '"), "name", F.lit("'")), none).alias("p"))
    gone = todo.where("go is not null").select("state", "no", "go", *(none.cast("string").alias(c) for c in ("element_id", "fill_value_key")), F.lit("navigate").alias("action"), F.lit(0).alias("ord"))
    gone = gone.select("state", pick(F.col("no"), [zero] * 3, F.concat(F.lit("recipe navigation to '"), "go", F.lit("'")), F.col("go")).alias("p"))
    links = able.where(fold(F.col("role")) == "link").withColumn("fill_value_key", none.cast("string")).select("state", pick(F.lit(ANY_LINK), [zero] * 3, F.lit("first unvisited non-blocked link rule"), none).alias("p"))
    best = matched.unionByName(gone).unionByName(links).groupBy("state").agg(F.min("p").alias("p"))
    out = states.select("state").join(best, "state", "left")
    return out.select("state", "p.element_id", "p.action", F.coalesce("p.rationale", F.lit("no viable unvisited candidate")).alias("rationale"), F.when(F.col("p").isNull(), "stop").otherwise("deterministic").alias("source"), "p.fill_value_key", F.col("p.go").alias("navigate_to"))


def decide_by_answers(states: DataFrame, candidates: DataFrame, answers: DataFrame, recipes: dict[str, list[tuple]] = RECIPES) -> DataFrame:
    """The same with a model's recorded answers (state, index, rationale): the index of a candidate that isn't blocked, or -1 to stop.

    Any other index, or none, leaves the choice to the recipes, and the rationale says so.
    """
    able = candidates.where("reason_blocked is null").select("state", (F.row_number().over(Window.partitionBy("state").orderBy("ord")) - 1).alias("index"), F.col("element_id").alias("own_id"), F.col("action").alias("own_action"), F.lit(True).alias("hit"))
    said = answers.select("state", "index", F.coalesce("rationale", F.lit("")).alias("said")).join(able, ["state", "index"], "left")
    d = decide(states, candidates, recipes).join(said, "state", "left")
    stop, hit, why = F.coalesce(F.col("index") == -1, F.lit(False)), F.coalesce("hit", F.lit(False)), F.coalesce("said", F.lit(""))
    of = lambda own, c: F.when(stop, None).when(hit, own).otherwise(F.col(c)).alias(c)
    return d.select(
        "state", of(F.col("own_id"), "element_id"), of(F.col("own_action"), "action"),
        F.when(stop | hit, why).otherwise(F.concat(F.lit("llm-out-of-range: "), why, F.lit("; deterministic-fallback: "), "rationale")).alias("rationale"),
        F.when(stop, "stop").when(hit, "llm").otherwise(F.col("source")).alias("source"), of(F.lit(None).cast("string"), "fill_value_key"), of(F.lit(None).cast("string"), "navigate_to"),
    )


def signed_in(url: Column, html: Column) -> Column:
    """An avatar or profile control is shown, or the user's name on a page other than the login page."""
    shown = html.rlike(r"""(?i)class\s*=\s*["']([^"']*\s)?(?-i:avatar)(\s[^"']*)?["']|aria-label\s*=\s*["'][^"']*profile""")
    return F.coalesce(shown | (html.contains("demo-user") & ~url.contains(LOGIN)), F.lit(False))


def issue_created(url: Column, html: Column) -> Column:
    return F.coalesce(url.rlike(r"/demo/demo-repo/issues/\d+") & html.contains("Crawler-created issue for flow F2"), F.lit(False))


def issue_watched(url: Column, html: Column) -> Column:
    return F.coalesce(url.contains("/demo/demo-repo/issues/1") & (html.contains("Unwatch") | html.contains("Unsubscribe")), F.lit(False))
