"""URL rules whose decisions reach the aliases of a page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.graph import components
from sediment.llm.tables import kept

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """``place`` is a host with a path, such as ``example.org/en/``; it holds for subdomains too."""

    place: str
    verdict: str

    @property
    def host(self) -> str:
        return self.place.partition("/")[0]

    @property
    def path(self) -> str:
        return self.place[len(self.host) :]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From behind ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a string; null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.place), r.place)):
        on_host = (host == rule.host) | host.endswith(f".{rule.host}")
        found = F.when(on_host & path.startswith(rule.path), rule.place).otherwise(found)
    return found


def plain_form(url: Column) -> Column:
    """Where the redirects lead that sites make themselves: the alias all spellings share.

    The scheme, a leading ``www.``, the fragment, ``utm_`` parameters and slashes at the
    end of the path go. Null where there is no ``://``.
    """
    rest = _after_scheme(url)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    parameters = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_"))
    kept_query = F.when(F.size(parameters) > 0, F.concat(F.lit("?"), F.array_join(parameters, "&"))).otherwise("")
    plain = F.concat(
        F.regexp_replace(host_of(url), r"^www\.", ""), F.regexp_replace(path_of(url), "/+$", ""), kept_query
    )
    return F.when(url.contains("://"), plain)


_CANONICAL = r"""(?is)\brel\s*=\s*(?:"(?:[^"]*\s)?canonical\b|'(?:[^']*\s)?canonical\b|canonical\b)"""
_REFRESH = r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""


def _targets(html: Column) -> Column:
    """All canonical links of a page, and all places that meta refreshes name."""

    def named(tag: str, kind: str, place: str) -> Column:
        tags = F.filter(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*+>"), F.lit(0)), lambda t: t.rlike(kind))
        return F.transform(tags, lambda t: F.regexp_extract(t, place, 1))

    worth = html.rlike(r"(?i)\bcanonical\b|\brefresh\b")
    html = F.regexp_replace(html, r"(?s)<!--.*?(-->|$)", "")
    links = named("link", _CANONICAL, r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)""")
    moves = named("meta", _REFRESH, r"""(?is)\burl\s*=\s*['"]?\s*([^"'\s>]+)""")
    return F.when(worth, F.filter(F.array_distinct(F.concat(links, moves)), lambda t: t != ""))


def _unescaped(link: Column) -> Column:
    """A link out of HTML, with the entities that links have read as characters."""
    # Entities and what they stand for; the ampersand comes last.
    for entity, text in (
        ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&#47;", "/"),
        ("&#x2f;", "/"), ("&#x2F;", "/"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&"),
    ):
        link = F.replace(link, F.lit(entity), F.lit(text))
    return link


def _without_dots(path: Column) -> Column:
    """A path that begins with a slash, with ``.`` and ``..`` taken out; never above the root."""
    nothing = F.array().cast("array<string>")

    def step(done, part):
        shorter = F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done)
        return F.when(part == ".", done).when(part == "..", shorter).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), nothing, step)
    plain = ~path.rlike(r"/\.\.?(/|$)")
    last = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(plain, path).otherwise(F.concat(F.array_join(parts, "/"), last))


def _absolute(target: Column, url: Column) -> Column:
    """A link as a whole URL, read relative to the page it stands on; null for other schemes.

    As browsers do: ``?…`` keeps the page's own path, ``#…`` is the page itself, ``//…``
    keeps its scheme, and dots in paths are resolved.
    """
    link = _unescaped(target)
    scheme = F.regexp_extract(url, r"^[^:]*:", 0)
    origin = F.regexp_extract(url, r"^[^:]*://[^/?#]*", 0)
    page = F.regexp_replace(path_of(url), "^$", "/")
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    path = F.regexp_extract(link, r"^[^?#]*", 0)
    rest = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(page, r"^.*/", 0)
    whole = link.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    return (
        F.when(whole, link)
        .when(link.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(path.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(path != "", F.concat(origin, _without_dots(F.concat(folder, path)), rest))
        .when(rest.startswith("?"), F.concat(origin, page, rest))
        .otherwise(F.concat(origin, page, query))
    )


def judge_urls(
    pages: DataFrame,
    rules: list[Rule],
    *,
    redirects: DataFrame | None = None,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str | None = "html",
    default: str = ALLOW,
) -> DataFrame:
    """A verdict for the URL of every page: id, ``host``, ``path``, ``rule``, ``verdict``, ``alias``.

    The longest rule that fits a URL decides. Where none fits, the URLs that redirects
    and canonical links join to it do: if a rule allows any of them it is allowed, else
    if one is blocked it is blocked, else ``default`` holds. ``alias`` names the
    component by its smallest plain form. Links are those of ``plain_form``, all canonical
    links and meta refreshes in ``html_column``, and ``redirects`` (columns ``from_url``
    and ``to_url``, whose targets need not be pages).

    A null URL, or one without ``://``, has empty host and path, no alias and the verdict
    ``default`` (a rule needs a host). Repeated rows are judged alike, each by itself; an
    empty table gives no rows.
    """
    url = F.col("url")
    columns = [F.col(f"`{id_column}`").alias("id"), F.col(f"`{url_column}`").cast("string").alias("url")]
    if html_column:
        columns.append(F.col(f"`{html_column}`").cast("string").alias("html"))
    read = pages.select(columns)
    if html_column:
        read = read.withColumn("to_urls", F.transform(_targets(F.col("html")), lambda t: _absolute(t, url))).drop("html")
    else:
        read = read.withColumn("to_urls", F.lit(None).cast("array<string>"))
    marked = kept(
        read.select(
            "id", host_of(url).alias("host"), path_of(url).alias("path"),
            plain_form(url).alias("plain"), "to_urls",
        ).withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    )
    edges = marked.select("plain", F.explode("to_urls").alias("to_url"))
    pairs = edges.select(F.col("plain").alias("u"), plain_form(F.col("to_url")).alias("v"))
    # Targets are URLs too, and may fit a rule without being pages.
    known = marked.select("plain", "rule")
    targets = edges.select("to_url")
    if redirects is not None:
        pairs = pairs.unionByName(
            redirects.select(plain_form(F.col("from_url")).alias("u"), plain_form(F.col("to_url")).alias("v"))
        )
        targets = targets.unionByName(redirects.select("to_url")).unionByName(
            redirects.select(F.col("from_url").alias("to_url"))
        )
    to = F.col("to_url")
    known = known.unionByName(
        targets.filter(to.isNotNull()).select(
            plain_form(to).alias("plain"), fitting_rule(host_of(to), path_of(to), rules).alias("rule")
        )
    )
    found = components(pairs.filter(F.col("u").isNotNull() & F.col("v").isNotNull()))
    allowed = [r.place for r in rules if r.verdict == ALLOW]
    # One row a plain form, added up before the join: however many pages share it.
    flags = kept(
        known.filter(F.col("plain").isNotNull())
        .groupBy("plain")
        .agg(
            F.coalesce(F.bool_or(F.col("rule").isin(allowed)), F.lit(False)).alias("allow"),
            F.coalesce(F.bool_or(F.col("rule").isNotNull() & ~F.col("rule").isin(allowed)), F.lit(False)).alias("block"),
        )
    )
    placed = kept(
        flags.join(found.withColumnRenamed("node", "plain"), "plain", "left")
        .select("plain", "allow", "block", F.coalesce("root", "plain").alias("alias"))
    )
    groups = kept(placed.groupBy("alias").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block")))
    by_plain = kept(placed.select("plain", "alias").join(groups, "alias"))
    own = F.when(F.col("rule").isNull(), None).when(F.col("rule").isin(allowed), ALLOW).otherwise(BLOCK)
    inherited = F.when(F.col("allow"), ALLOW).when(F.col("block"), BLOCK)
    return marked.join(by_plain, "plain", "left").select(
        F.col("id").alias(id_column), "host", "path", "rule",
        F.coalesce(own, inherited, F.lit(default)).alias("verdict"), "alias",
    )
