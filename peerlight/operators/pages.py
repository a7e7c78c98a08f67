"""Mining of stored web pages (page_id, url, html): links, profiles, labelled fields, result lists, candidate scores, stitched rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import checkpointed, discard

# Hosts by class, suffixes that aren't pages, path words that tell a site's inner pages.
SOCIAL = ("instagram.com", "www.instagram.com", "m.instagram.com", "facebook.com", "www.facebook.com", "x.com", "www.x.com", "twitter.com", "www.twitter.com", "tiktok.com", "www.tiktok.com", "youtube.com", "www.youtube.com")
DIRECTORIES = ("www.wam.go.jp", "wam.go.jp", "snabi.jp", "www.snabi.jp", "shohgaisha.com", "www.shohgaisha.com", "litalico-c.jp", "www.litalico-c.jp")
BRIDGES = ("linktr.ee", "www.linktr.ee", "lit.link", "www.lit.link", "bio.site", "www.bio.site", "carrd.co", "www.carrd.co", "instabio.cc", "www.instabio.cc", "taplink.cc", "www.taplink.cc")
NOT_PAGES = (".css", ".js", ".json", ".xml", ".rss", ".txt", ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".ico", ".mp4", ".mov", ".webm", ".mp3", ".wav", ".woff", ".woff2", ".ttf", ".otf", ".zip")
PAGE_WORDS = ("/about", "/aboutus", "/company", "/facility", "/office", "/access", "/contact", "/profile", "/service", "/news", "/blog", "/staff", "/guide", "/support", "/works", "/business", "/jigyosyo", "/center", "/shop", "/tenpo", "/day", "/information", "/sns")

HREF = "(?i)href=[\"']([^\"']+)[\"']"


def host_class(host: Column, social=SOCIAL, directories=DIRECTORIES, bridges=BRIDGES) -> Column:
    return F.when(host.isNull(), None).when(host.isin(*social), "social").when(host.isin(*directories), "directory").when(host.isin(*bridges), "bridge").otherwise("homepage")


def page_like(url: Column) -> Column:
    return url.isNotNull() & ~F.lower(T.url_path(url)).rlike("(" + "|".join(s.replace(".", "\\.") for s in NOT_PAGES) + ")$")


def resolved(href: Column, base: Column) -> Column:
    """A link on the page ``base`` (canonical) as a canonical URL: absolute, host-relative and path-relative forms."""
    root = F.regexp_extract(base, "^(https?://[^/]+)", 1)
    scheme = F.regexp_extract(base, "^(https?:)", 1)
    folder = F.regexp_replace(F.concat(base, F.when(T.url_path(base) == "", "/").otherwise("")), "[^/]*$", "")
    whole = F.when(href.rlike("(?i)^https?://"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, href)).when(F.startswith(href, F.lit("/")), F.concat(root, href)).when(href.rlike("^(?i)([a-z][a-z0-9+.-]*:|#|\\?)"), None).otherwise(F.concat(folder, href))
    return T.canonical_url(whole)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, base, url, position): every distinct link of a page at its first position."""
    text = F.replace(F.replace("html", F.lit("\\/"), F.lit("/")), F.lit("\\u003a"), F.lit(":"))
    each = pages.select("page_id", T.canonical_url(F.col("url")).alias("base"), F.posexplode(F.regexp_extract_all(text, F.lit(HREF), 1)).alias("position", "href"))
    urls = each.select("page_id", "base", "position", resolved(T.unescaped(F.col("href"), False), F.col("base")).alias("url")).filter("url is not null")
    return urls.groupBy("page_id", "base", "url").agg(F.min("position").alias("position"))


def extract_profile_links(pages: DataFrame, pattern: str, limit: int | None = None) -> DataFrame:
    """(page_id, profiles): distinct matches of a profile pattern in the text, then in the links, in order."""
    text = F.regexp_extract_all("html", F.lit(pattern), 0)
    links = F.filter(F.regexp_extract_all("html", F.lit(HREF), 1), lambda x: x.rlike(pattern))
    found = F.array_distinct(F.concat(text, F.transform(links, lambda x: F.regexp_extract(x, pattern, 0))))
    return pages.select("page_id", (F.slice(found, 1, limit) if limit else found).alias("profiles"))


def rank_internal_links(links: DataFrame, words: tuple[str, ...] = PAGE_WORDS, enough: int = 8, most: int = 10) -> DataFrame:
    """(page_id, url, place): same-host pages; those with a path word first (more words, shorter, by text), others only while there are fewer than ``enough``; ``most`` at most."""
    path = F.lower(T.url_path(F.col("url")))
    hits = F.array_size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(path, w)))
    inner = links.filter((T.url_host(F.col("url")) == T.url_host(F.col("base"))) & (F.col("url") != F.col("base")) & page_like(F.col("url"))).withColumn("_hits", hits)
    w = Window.partitionBy("page_id")
    placed = inner.withColumn("place", F.row_number().over(w.orderBy((F.col("_hits") > 0).cast("int").desc(), F.desc("_hits"), F.length("url"), "url"))).withColumn("_words", F.count_if(F.col("_hits") > 0).over(w))
    return placed.filter((F.col("place") <= most) & ((F.col("_hits") > 0) | (F.col("_words") < enough))).select("page_id", "url", "place")


def extract_bridge_links(links: DataFrame, hosts: tuple[str, ...] = BRIDGES, most: int = 3) -> DataFrame:
    found = links.filter(T.url_host(F.col("url")).isin(*hosts))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("position"))).filter(F.col("place") <= most).select("page_id", "url", "place")


def sitemap_pages(sitemaps: DataFrame, words: tuple[str, ...] = PAGE_WORDS, most: int = 6) -> DataFrame:
    """(host, url, place) out of stored sitemaps (url, body): page-like <loc> values of the same host, path words first, ``most`` a host."""
    host = T.url_host(T.canonical_url(F.col("url")))
    each = sitemaps.select(host.alias("host"), F.explode(F.regexp_extract_all("body", F.lit("(?is)<loc>(.*?)</loc>"), 1)).alias("loc")).select("host", T.canonical_url(F.col("loc")).alias("url")).distinct()
    path = F.lower(T.url_path(F.col("url")))
    hits = F.array_size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(path, w)))
    good = each.filter((T.url_host(F.col("url")) == F.col("host")) & page_like(F.col("url")))
    return good.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy(hits.desc(), F.length("url"), "url"))).filter(F.col("place") <= most)


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(host, url) of the ``Sitemap:`` lines of stored robots texts (url, body)."""
    lines = F.regexp_extract_all("body", F.lit("(?im)^\\s*sitemap:\\s*(\\S+)"), 1)
    return robots.select(T.url_host(T.canonical_url(F.col("url"))).alias("host"), F.explode(lines).alias("raw")).select("host", T.canonical_url(F.col("raw")).alias("url")).filter("url is not null").distinct()


def page_outcomes(pages: DataFrame, profiles: DataFrame, inner: DataFrame, bridges: DataFrame) -> DataFrame:
    """(id, own, bridged, next): of each page its first profile, the first one of its bridges in their order, and its inner pages in theirs; only stored pages count.

    A link means the stored page with the smallest id of that URL.  ``profiles`` has (page_id, profiles), ``inner`` and ``bridges`` (page_id, url, place), a few for each page.
    """
    first = profiles.select(F.col("page_id").alias("id"), F.get("profiles", F.lit(0)).alias("own")).filter("own is not null")
    at = pages.select(F.col("page_id").alias("_id"), T.canonical_url(F.col("url")).alias("_url")).filter("_url is not null").groupBy("_url").agg(F.min("_id").alias("_id"))
    step = lambda via: via.join(at, via.url == F.col("_url")).select("page_id", F.col("_id").alias("to"), "place")
    bridged = step(bridges).join(first.select(F.col("id").alias("to"), "own"), "to").groupBy(F.col("page_id").alias("id")).agg(F.min(F.struct("place", "own")).alias("_b")).select("id", F.col("_b.own").alias("bridged"))
    follow = step(inner).groupBy(F.col("page_id").alias("id")).agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("place", "to"))), lambda x: x["to"])).alias("next"))
    ids = pages.select(F.col("page_id").alias("id")).distinct()
    out = ids.join(first, "id", "left").join(bridged, "id", "left").join(follow, "id", "left")
    return out.withColumn("next", F.coalesce("next", F.array().cast("array<long>")))


def profile_reachability(pages: DataFrame, links: DataFrame, profiles: DataFrame, inner: DataFrame, bridges: DataFrame, maps: DataFrame | None = None, checks: int = 8, map_checks: int = 4) -> DataFrame:
    """(page_id, profile, phase): the first profile that a start page reaches over stored pages, as a queue of pages finds it.

    Phases: 0 the page itself, 1 its bridges, 2 an inner page, 3 the bridges of an inner page, 4 a page of the site's map, 5 its bridges.  At most ``checks`` inner pages are visited, in the order in which
    they were met: a page's inner links join the queue when it is visited, unless they are in it or have been visited, so the depth isn't bounded, only the number of pages.  Then come
    ``map_checks`` pages of the map (``maps``: host, url, place) that were neither visited nor waiting.

    A round visits the next page of every start page that is still searching: one join of the frontier with the pages' outcomes.  The frontier has a row a start page, with
    its queue and what it has visited, both of bounded length; it is written after each round.
    """
    nodes = checkpointed(page_outcomes(pages, profiles, inner, bridges))
    found = lambda own, bridged, at: F.when(own.isNotNull(), F.struct(own.alias("profile"), F.lit(at).alias("phase"))).when(bridged.isNotNull(), F.struct(bridged.alias("profile"), F.lit(at + 1).alias("phase")))
    c = F.col
    state = checkpointed(nodes.select(c("id").alias("page_id"), found(c("own"), c("bridged"), 0).alias("got"), c("next").alias("queue"), F.array().cast("array<long>").alias("seen")))
    done = state.filter("got is not null").select("page_id", "got")
    written, searching = [state], state.filter("got is null").drop("got")
    for _ in range(checks):
        head = F.get("queue", F.lit(0))
        moved = searching.join(nodes.select(c("id").alias("_id"), "own", "bridged", "next"), head == c("_id"), "left")
        rest, seen = F.slice("queue", 2, F.greatest(F.size("queue"), F.lit(1))), F.when(head.isNotNull(), F.array_append("seen", head)).otherwise(c("seen"))
        more = F.filter(F.coalesce("next", F.array().cast("array<long>")), lambda x: ~F.array_contains(rest, x) & ~F.array_contains(seen, x))
        state = checkpointed(moved.select("page_id", found(c("own"), c("bridged"), 2).alias("got"), F.concat(rest, more).alias("queue"), seen.alias("seen")))
        written.append(state)
        done = done.unionByName(state.filter("got is not null").select("page_id", "got"))
        searching = state.filter("got is null").drop("got")
    if maps is not None:
        at = pages.select(c("page_id").alias("_id"), T.canonical_url(c("url")).alias("_url")).filter("_url is not null").groupBy("_url").agg(F.min("_id").alias("_id"))
        listed = maps.join(at, maps.url == c("_url")).groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", c("_id").alias("to")))), lambda x: x["to"]).alias("_map"))
        hosts = pages.select("page_id", T.url_host(T.canonical_url(c("url"))).alias("host")).distinct()
        fresh = F.slice(F.filter("_map", lambda x: ~F.array_contains("seen", x) & ~F.array_contains("queue", x)), 1, map_checks)
        tried = searching.join(hosts, "page_id").join(listed, "host").select("page_id", F.posexplode(fresh).alias("_p", "_to")).join(nodes, c("_to") == c("id"))
        of_map = tried.withColumn("got", found(c("own"), c("bridged"), 4)).filter("got is not null").groupBy("page_id").agg(F.min(F.struct("_p", "got")).alias("_x")).select("page_id", c("_x.got").alias("got"))
        done = done.unionByName(of_map)
    out = checkpointed(done.select("page_id", "got.profile", "got.phase"))
    discard(nodes, *written)
    return out


def extract_labelled_fields(pages: DataFrame, label: str, value: str, wanted: tuple[str, ...]) -> DataFrame:
    """(page_id, one column a wanted label): values beside labels found by two patterns with one group; the last of a label wins."""
    pairs = F.arrays_zip(F.regexp_extract_all("html", F.lit(label), 1).alias("l"), F.regexp_extract_all("html", F.lit(value), 1).alias("v"))
    each = pages.select("page_id", F.posexplode(pairs).alias("position", "p")).select("page_id", "position", T.strip_markup(F.col("p.l"), False).alias("label"), T.strip_markup(F.col("p.v"), False).alias("value"))
    last = each.groupBy("page_id", "label").agg(F.max_by("value", "position").alias("value"))
    return last.groupBy("page_id").pivot("label", list(wanted)).agg(F.first("value"))


# The markup of stored result pages; words that candidates are scored by.
SERVICE_WORDS, OFFICIAL_WORDS, PENALTY_WORD = ("就労継続支援", "b型", "障がい"), ("公式", "official"), "instagram"
RESULT = '(?s)<a rel="nofollow" class="result__a" href="(.*?)">(.*?)</a>(?:(?!class="result__a").)*?<a class="result__snippet" href=".*?">(.*?)</a>'


def parse_result_lists(pages: DataFrame, pattern: str = RESULT, most: int = 8) -> DataFrame:
    """(page_id, position, url, title, snippet) of stored result pages: the first ``most`` items, those without a good URL dropped."""
    group = lambda i: F.slice(F.regexp_extract_all("html", F.lit(pattern), i), 1, most)
    each = pages.select("page_id", F.posexplode(F.arrays_zip(group(1).alias("u"), group(2).alias("t"), group(3).alias("s"))).alias("position", "r"))
    return each.select("page_id", "position", T.canonical_url(F.col("r.u")).alias("url"), T.strip_markup(F.col("r.t")).alias("title"), T.strip_markup(F.col("r.s")).alias("snippet")).filter("url is not null")


def parse_feeds(pages: DataFrame, most: int = 8) -> DataFrame:
    """The same from RSS in ``html``: link, title and description of each item; markup that isn't well-formed is read as far as it goes."""
    items = F.slice(F.regexp_extract_all("html", F.lit("(?is)<item\\b[^>]*>(.*?)</item>"), 1), 1, most)
    text = lambda x: F.regexp_replace(F.regexp_extract("item", f"(?is)<{x}\\b[^>]*>(.*?)</{x}>", 1), "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1")
    each = pages.select("page_id", F.posexplode(items).alias("position", "item"))
    return each.select("page_id", "position", T.canonical_url(text("link")).alias("url"), T.strip_markup(text("title")).alias("title"), T.strip_markup(text("description")).alias("snippet")).filter("url is not null")




def page_texts(pages: DataFrame, blocked: Column, words: tuple[str, ...] = SERVICE_WORDS, penalty: str | None = PENALTY_WORD, nfkc: bool = True) -> DataFrame:
    """Adds what scores ask of a page (url, title, snippet) alone: its cleaned text, whether it has a word or the penalty's, and whether its host is blocked."""
    rows = pages.withColumn("_text", T.match_text(F.concat_ws(" ", "title", "snippet", "url"), nfkc))
    word = F.lit(False)
    for w in words:
        word = word | F.contains("_text", F.lit(w))
    return rows.withColumns({"_word": word, "_penalty": F.contains("_text", F.lit(penalty)) if penalty else F.lit(False), "_blocked": blocked})


def office_texts(offices: DataFrame, nfkc: bool = True) -> DataFrame:
    """Adds what scores ask of an office (office_name, corporation_name, municipality) alone: its cleaned names."""
    return offices.withColumns({"_office": T.match_text(F.col("office_name"), nfkc), "_corp": T.match_text(T.without_legal_suffix(F.col("corporation_name")), nfkc), "_area": T.match_text(F.col("municipality"), nfkc)})


def score_pairs(pairs: DataFrame, word_name: str = "service") -> DataFrame:
    """Adds score and reason to rows of ``page_texts`` and ``office_texts`` beside each other: name 6, company 3, area 1, words 1, penalty -2; blocked hosts -999."""
    has = {k: (F.col(f"_{k}") != "") & F.contains("_text", f"_{k}") for k in ("office", "corp", "area")} | {word_name: F.col("_word")}
    points = {"office": 6, "corp": 3, "area": 1, word_name: 1}
    score = sum((F.when(has[k], p).otherwise(0) for k, p in points.items()), F.lit(0)) - F.when(F.col("_penalty"), 2).otherwise(0)
    reason = F.coalesce(F.nullif(F.concat_ws("+", *[F.when(has[k], F.lit(k)) for k in points]), F.lit("")), F.lit("weak"))
    blocked = F.col("_blocked")
    return pairs.withColumns({"score": F.when(blocked, -999).otherwise(score), "reason": F.when(blocked, "blocked").otherwise(reason)}).drop("_text", "_word", "_penalty", "_blocked", "_office", "_corp", "_area")


def score_candidates(pairs: DataFrame, blocked: Column, words: tuple[str, ...] = SERVICE_WORDS, word_name: str = "service", penalty: str | None = PENALTY_WORD, nfkc: bool = True) -> DataFrame:
    """``score_pairs`` of rows (office_name, corporation_name, municipality, url, title, snippet) that haven't been cleaned on their own sides."""
    return score_pairs(office_texts(page_texts(pairs, blocked, words, penalty, nfkc), nfkc), word_name)


def pick_best_candidate(scored: DataFrame, key: str, position: str, least: int = 6, pages: DataFrame | None = None) -> DataFrame:
    """(key, url, score, confidence): the highest score, the first of ties; none below ``least``.

    Where ``position`` names a page, ``pages`` (position, url) gives the URLs, and candidates are reduced to the first position of each score, by hash, before any row is moved.
    """
    good = scored.filter(F.col("score") >= least)
    if pages is None:
        best = good.groupBy(key).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(position).alias("p"), F.col("url").alias("u"))).alias("_x")).select(key, (-F.col("_x.s")).alias("score"), F.col("_x.u").alias("url"))
    else:
        first = good.groupBy(key, "score").agg(F.min(position).alias(position))
        best = first.groupBy(key).agg(F.max(F.struct("score", position)).alias("_x")).select(key, "_x.*").join(pages.select(position, "url"), position, "left")
    return best.select(key, "url", "score", F.when(F.col("score") >= 8, "high").when(F.col("score") >= 5, "medium").otherwise("low").alias("confidence"))


def stitch_multiline_rows(texts: DataFrame, key: str, text: str, start: str = "^[0-9]{10}", skip: str = "^\\s*$") -> DataFrame:
    """(key, row, content): lines that match ``start`` open a row, others are appended to it with a space; skipped lines and those before the first row go."""
    lines = texts.select(key, F.filter(F.split(text, "\n"), lambda x: ~x.rlike(skip)).alias("_lines"))
    # where rows open, once; a row is the slice up to the next opening, so each line is copied once, in the task that has the document
    opened = lines.select(key, "_lines", F.filter(F.transform("_lines", lambda x, i: F.when(x.rlike(start), i + 1)), lambda i: i.isNotNull()).alias("_open"))
    rows = F.transform("_open", lambda i, k: F.array_join(F.transform(F.slice("_lines", i, F.coalesce(F.get("_open", k + 1), F.size("_lines") + 1) - i), lambda x: F.trim(x)), " "))
    return opened.select(key, F.posexplode(rows).alias("row", "content"))


def parse_stitched_rows(rows: DataFrame, shape: str = "^([0-9]{10})\\s+(.+?)\\s+大阪市", url: str = "(?i)(?:https?://|https//|http//|hxxps?://|hyyps?://|www\\.)[^\\s\\u3000]+") -> DataFrame:
    """Adds number, name and the first URL (damaged schemes allowed) of each stitched row."""
    part = lambda i: F.nullif(F.regexp_extract("content", shape, i), F.lit(""))
    return rows.withColumns({"number": part(1), "name": part(2), "url": T.canonical_url(F.regexp_extract("content", url, 0))})
