"""URLs: cleaning, browser sites, conversation aliases, Markdown images, safe metadata."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from scrollmill.functions.ids import col

URL = r"^(?i)(https?)://(?:[^/?#@\\]*@)?([^/?#:@\\\s]+)(?::(\d*))?([/][^?#\\]*)?(?:[?#].*)?$"
PLACEHOLDER = "removed:image"
MEDIA = ("image", "audio", "video", "file")

#: The capture sites (id, label, hosts, valid path).
SITES = (
    ("chatgpt", "ChatGPT", ("chatgpt.com", "chat.openai.com"), r"^/(c|share|g|gg)/"),
    ("claude", "Claude", ("claude.ai",), r"^/chat/.+"),
    ("gemini", "Gemini", ("gemini.google.com",), r"^/(.+/)?(app/.+|gem/.+/.+)"),
    ("deepseek", "DeepSeek", ("chat.deepseek.com",), r"^/a/chat/s/[^/]+$"),
    ("kimi", "Kimi", ("kimi.com", "moonshot.cn"), r"^/chat/[^/]+"),
    ("qianwen", "Qwen", ("qianwen.com",), r"^/chat/[a-f0-9]+$"),
    ("doubao", "Doubao", ("doubao.com",), r"^/chat/(?!local)[^/]+"),
    ("yuanbao", "Tencent Yuanbao", ("yuanbao.tencent.com",), r"^/chat/[^/]+/[^/]+$"),
    ("grok", "Grok", ("grok.com",), r"^(/(chat|c)/[^/]+|/)$"),
    ("perplexity", "Perplexity", ("perplexity.ai",), r"^/(search/[^/]+|spaces/[^/]+/search/[^/]+)"),
    ("notebooklm", "NotebookLM", ("notebooklm.google.com",), r"^/notebook/[^/]+"),
    ("google-ai-studio", "Google AI Studio", ("aistudio.google.com",), r"^/(app/)?(u/\d+/)?prompts/[^/]+"),
    ("github-copilot", "GitHub Copilot", ("github.com",), r"^/copilot(?:/.*)?$"),
    ("microsoft-copilot", "Microsoft Copilot", ("copilot.microsoft.com",), r"^/($|chats?/[^/]+|threads?/[^/]+)"),
)
#: Where a site keeps the conversation's id in the path.
ID_PATHS = {
    "perplexity": r"/search/([^/?#]+)",
    "deepseek": r"/a/chat/s/([^/?#]+)",
    "grok": r"/(?:chat|c)/([^/?#]+)",
    "microsoft-copilot": r"/(?:chats?|threads?)/([^/?#]+)",
    "yuanbao": r"/chat/[^/?#]+/([^/?#]+)",
    "gemini": r"([^/]+)/*$",
    "notebooklm": r"/notebook/([^/?#]+)",
    "google-ai-studio": r"/(?:app/)?(?:u/\d+/)?prompts/([^/?#]+)",
    "github-copilot": r"/copilot/c/([^/?#]+)",
}


def part(url, group: int) -> Column:
    return F.regexp_extract(F.trim(col(url)), URL, group)


def clean_url(url) -> Column:
    """http and https only, without user, password, query and fragment; null for others."""
    scheme, port = F.lower(part(url, 1)), part(url, 3)
    usual = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    path = F.coalesce(F.nullif(part(url, 4), F.lit("")), F.lit("/"))
    whole = F.concat(scheme, F.lit("://"), F.lower(part(url, 2)), F.when(usual, "").otherwise(F.concat(F.lit(":"), port)), path)
    return F.when(F.trim(col(url)).rlike(URL), whole)


def clean_one(url: str | None) -> str | None:
    """The same rule for one Python string."""
    m = re.match(URL.replace("^(?i)", "(?i)^"), (url or "").strip())
    if not m:
        return None
    scheme, host, port, path = m[1].lower(), m[2].lower(), m[3] or "", m[4] or "/"
    usual = port in ("", "80" if scheme == "http" else "443")
    return f"{scheme}://{host}{'' if usual else ':' + port}{path}"


def path_of(url) -> Column:
    """The path of an http(s) URL, null for others."""
    return F.when(F.trim(col(url)).rlike(URL), F.coalesce(F.nullif(part(url, 4), F.lit("")), F.lit("/")))


def aliases(source="source_id", upstream="upstream_id", url="url") -> Column:
    """Ids under which a conversation may be stored: for some browser sites also those its URL gives."""
    site = F.regexp_replace(col(source), "^browser-extension-", "")
    own = F.array_compact(F.array(F.nullif(col(upstream), F.lit(""))))
    path = path_of(url)
    found = lambda pattern: F.nullif(F.regexp_extract(path, pattern, 1), F.lit(""))
    thread = F.coalesce(F.nullif(F.regexp_extract(col(upstream), r"^search_(.+)$", 1), F.lit("")), F.nullif(F.regexp_extract(col(upstream), r"_search_(.+)$", 1), F.lit("")), F.nullif(col(upstream), F.lit("")))
    canonical = F.lit(None).cast("string")
    for name, pattern in ID_PATHS.items():
        value = F.coalesce(thread, found(pattern)) if name == "perplexity" else found(pattern)
        canonical = F.when(site == name, value).otherwise(canonical)
    flat = F.nullif(F.replace(F.regexp_replace(path, r"^/+|/+$", ""), F.lit("/"), F.lit("_")), F.lit(""))
    every = F.array_distinct(F.array_compact(F.array(canonical, F.nullif(col(upstream), F.lit("")), flat, F.nullif(col(url), F.lit("")))))
    return F.when(col(source).startswith("browser-extension-") & site.isin(*ID_PATHS), every).otherwise(own)


def sites(spark: SparkSession) -> DataFrame:
    """The registry: one row per site, 14 in all."""
    rows = [(i, f"browser-extension-{i}", label, list(hosts), path) for i, label, hosts, path in SITES]
    return spark.createDataFrame(rows, "site string, source_id string, source_label string, hosts array<string>, path_pattern string")


def match_sites(captures: DataFrame, registry: DataFrame) -> DataFrame:
    """Captures (site, source_id, source_label, url) whose id, source, label, host and path agree with the registry."""
    host, path = F.lower(part("url", 2)), path_of("url")
    named = F.exists("hosts", lambda h: (host == h) | host.endswith(F.concat(F.lit("."), h)))
    joined = captures.join(F.broadcast(registry), ["site", "source_id", "source_label"])
    return joined.filter((F.lower(part("url", 1)) == "https") & named & F.regexp_like(path, F.col("path_pattern"))).drop("hosts", "path_pattern")


def safe_attachments(items) -> Column:
    """array<struct<name, url>>: an item with a URL that is not safe goes; one without a URL stays."""
    fixed = F.transform(col(items), lambda a: F.struct(a["name"].alias("name"), clean_url(a["url"]).alias("url"), (a["url"].isNotNull() & clean_url(a["url"]).isNull()).alias("bad")))
    return F.transform(F.filter(fixed, lambda a: ~a["bad"]), lambda a: F.struct(a["name"], a["url"]))


def safe_citations(items) -> Column:
    """array<struct<title, url>>: only items with a safe URL."""
    fixed = F.transform(col(items), lambda a: F.struct(a["title"].alias("title"), clean_url(a["url"]).alias("url")))
    return F.filter(fixed, lambda a: a["url"].isNotNull())


def safe_media(items) -> Column:
    """array<struct<type, title, url, thumbnail, width>>: unsafe URLs and items with neither URL nor title go; odd types are unknown."""
    fixed = F.transform(
        col(items),
        lambda m: F.struct(
            F.when(m["type"].isin(*MEDIA), m["type"]).otherwise("unknown").alias("type"),
            m["title"].alias("title"),
            clean_url(m["url"]).alias("url"),
            clean_url(m["thumbnail"]).alias("thumbnail"),
            F.when(m["width"] >= 0, m["width"]).alias("width"),
            ((m["url"].isNotNull() & clean_url(m["url"]).isNull()) | (m["thumbnail"].isNotNull() & clean_url(m["thumbnail"]).isNull()) | (m["url"].isNull() & m["title"].isNull())).alias("bad"),
        ),
    )
    return F.transform(F.filter(fixed, lambda m: ~m["bad"]), lambda m: F.struct(m["type"], m["title"], m["url"], m["thumbnail"], m["width"]))


IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*(?:<([^>\n]*)>|((?:\\.|[^\s()\\])+))(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")


@F.pandas_udf(StringType())
def _images(texts: pd.Series) -> pd.Series:
    def one(m: re.Match) -> str:
        target = re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[2] if m[2] is not None else m[3])
        return f"![{m[1]}]({clean_one(target) or PLACEHOLDER})"

    return texts.map(lambda t: None if t is None else IMAGE.sub(one, t))


def clean_images(text) -> Column:
    """Markdown image targets cleaned, unsafe ones replaced; rows without an image stay in the JVM's branch."""
    return F.when(col(text).contains("!["), _images(F.when(col(text).contains("!["), col(text)))).otherwise(col(text))


def conversation_uri(id_, scheme: str = "history") -> Column:
    return F.concat(F.lit(f"{scheme}://conversation/"), F.replace(F.url_encode(col(id_)), F.lit("+"), F.lit("%20")))
