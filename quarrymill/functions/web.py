"""E-mail addresses, URLs and social profiles as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.functions.text import blank_to_null, clean_text, col, let, strip_chars

#: Mail providers whose domains say nothing about a company.
FREE_MAIL_DOMAINS = (
    "gmail.com", "hotmail.com", "hotmail.be", "outlook.com", "outlook.be", "live.be", "live.com", "yahoo.com", "yahoo.fr",
    "icloud.com", "me.com", "telenet.be", "skynet.be", "proximus.be", "scarlet.be", "msn.com", "protonmail.com",
)
#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref")
#: Hosts of social networks, and how their profile URLs begin.
SOCIAL_HOSTS = {
    "linkedin": ("linkedin.com",),
    "facebook": ("facebook.com", "fb.com", "fb.me"),
    "instagram": ("instagram.com",),
    "twitter": ("twitter.com", "x.com"),
    "youtube": ("youtube.com", "youtu.be"),
    "tiktok": ("tiktok.com",),
}
PROFILE_STARTS = {
    "linkedin": "https://www.linkedin.com/company/",
    "facebook": "https://www.facebook.com/",
    "instagram": "https://www.instagram.com/",
    "twitter": "https://x.com/",
    "youtube": "https://www.youtube.com/",
    "tiktok": "https://www.tiktok.com/@",
}
#: Paths that are no profiles.
NO_PROFILE = r"sharer|share|intent|login|policies|privacy|help|dialog|plugins|hashtag|explore|home|search|legal|tr\?|about|terms|settings|reel/|watch|groups/feed"
#: Parts of domains of directories, networks and review sites.
DIRECTORY_MARKERS = (
    "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "pinterest.",
    "tripadvisor.", "yelp.", "google.", "openstreetmap.org", "wikipedia.org", "wikidata.org", "foursquare.com",
    "goudengids.be", "pagesdor.be", "pagesjaunes.", "goldenpages.", "yellowpages.", "trustpilot.", "restaurantguru.",
    "thefork.", "deliveroo.", "ubereats.", "takeaway.com", "just-eat.", "booking.com", "expedia.", "hotels.com",
    "kbo-bce.", "companyweb.be", "trendstop.", "bizzy.org", "staatsbladmonitor.be", "north-data.", "opencorporates.",
    "indeed.", "glassdoor.", "jobat.be", "vdab.be", "cylex", "infobel.", "telefoonboek.", "1207.be", "1307.be",
    "mapcarta.", "waze.com", "apple.com/maps", "bing.com", "duckduckgo.com", "amazon.", "bol.com", "marktplaats.",
    "2dehands.be", "immoweb.be", "zimmo.be", "unizo.be", "voka.be", "openingsuren", "openinghours", "cybo.com",
    "menu.", "quandoo.", "zomato.", "resengo.", "kortrijk.be", "visitkortrijk", "uitinvlaanderen.", "streetdir",
)
_WRAPPERS = "<>\"' ,;"


def _quoted(parts) -> str:
    return "|".join(p.replace(".", r"\.") for p in parts)


def normalize_email(x: Column | str) -> Column:
    """Lower case, without wrappers, ``mailto:``, queries and spaces; spelled-out marks replaced; null without @."""
    t = strip_chars(clean_text(x), _WRAPPERS)
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, "(?i)^mailto:", ""), r"(?s)\?.*$", ""))
    t = F.regexp_replace(t, r" \[at\] |\(at\)|\[at\]", "@")
    t = F.regexp_replace(t, r" \[dot\] |\[dot\]|\(dot\)", ".")
    return let(F.replace(t, F.lit(" "), F.lit("")), lambda v: F.when(v.contains("@"), F.lower(v)))


def is_valid_email(x: Column | str) -> Column:
    """Never null: a missing address isn't valid."""
    form = r"^[A-Za-z0-9._%+\-']+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}$"
    good = lambda v: v.rlike(form) & ~v.contains("..") & ~v.startswith(".") & ~v.endswith(".")
    return F.coalesce(let(x, good), F.lit(False))


def email_domain(x: Column | str) -> Column:
    return let(x, lambda v: F.when(v.contains("@"), F.lower(F.substring_index(v, "@", -1))))


def _part(x: Column, group: int) -> Column:
    """Scheme, authority, path or query (groups 1 to 4) of a URL with a scheme."""
    return F.regexp_extract(x, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", group)


def _host(authority: Column) -> Column:
    """The host alone, lower-cased: user data and port taken away."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def normalize_url(x: Column | str) -> Column:
    """http(s) with a lower-case host that has a dot; no default port, tracking parameters, fragment or last slash.
    Null for anything else, mail addresses included."""

    def full(t: Column) -> Column:
        low = F.lower(t)
        mail = low.startswith("mailto:") | (F.substring_index(t, "/", 1).contains("@") & ~low.startswith("http"))
        whole = F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t).otherwise(F.concat(F.lit("https://"), F.ltrim(t, F.lit("/"))))
        return F.when(~mail, whole)

    def parts(u: Column) -> Column:
        authority = _part(u, 2)
        return F.struct(F.lower(_part(u, 1)).alias("scheme"), _host(authority).alias("host"), F.regexp_extract(authority, ":([0-9]+)$", 1).alias("port"), _part(u, 3).alias("path"), _part(u, 4).alias("query"))

    def canonical(s: Column) -> Column:
        scheme, host, port, path = s["scheme"], s["host"], s["port"], s["path"]
        default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
        shown = F.when(default, host).otherwise(F.concat(host, F.lit(":"), port.try_cast("int").cast("string")))
        path = F.when(path.isin("", "/"), F.lit("/")).otherwise(F.rtrim(path, F.lit("/")))
        out = F.concat(scheme, F.lit("://"), shown, path, _query(s["query"]))
        return F.when(scheme.isin("http", "https") & host.contains(".") & (F.length(port) <= 5), out)

    return let(let(let(strip_chars(clean_text(x), _WRAPPERS), full), parts), canonical)


def _query(query: Column) -> Column:
    """Without tracking parameters; each part decoded and encoded again, so that equal queries look alike."""
    again = lambda v: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(v), v)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "(?s)^[^=]*=", "")).otherwise(F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    pairs = F.transform(kept, lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.lit("="), again(value(p))))
    return let(F.array_join(pairs, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))


def url_domain(x: Column | str) -> Column:
    """The host without a leading ``www.``; a scheme may be missing."""
    host = lambda v: _host(_part(F.when(v.contains("://"), v).otherwise(F.concat(F.lit("https://"), v)), 2))
    return blank_to_null(F.regexp_replace(let(x, host), r"^www\.", ""))


def _within(host: Column, domain: str) -> Column:
    return (host == domain) | host.endswith("." + domain)


def social_network(x: Column | str) -> Column:
    def of(host: Column) -> Column:
        out = F.lit(None).cast("string")
        for network, domains in reversed(SOCIAL_HOSTS.items()):
            for d in domains:
                out = F.when(_within(host, d), F.lit(network)).otherwise(out)
        return out

    return let(url_domain(x), of)


def normalize_social(x: Column | str, network: Column | str) -> Column:
    """A profile URL from a handle or a URL of ``network`` (a name, or a column of names); null for other networks, share
    links and bare hosts."""
    network = F.lit(network) if isinstance(network, str) else network
    start = F.lit("https://")
    for name, url in PROFILE_STARTS.items():
        start = F.when(network == name, F.lit(url)).otherwise(start)

    def profile(url: Column) -> Column:
        path = _part(url, 3)
        good = (social_network(url) == network) & ~url.rlike(f"(?i)/({NO_PROFILE})") & ~path.isin("", "/")
        return F.when(good & ((network != "linkedin") | path.rlike("^/(company|in|school|showcase)/[^/]+")), url)

    def of(t: Column) -> Column:
        is_url = t.contains(".") & (t.contains("/") | F.lower(t).startswith("http") | F.lower(t).startswith("www"))
        handle = F.when(t.rlike(r"^[A-Za-z0-9._\-]+$"), F.concat(start, t))
        return F.when(is_url, let(normalize_url(t), profile)).otherwise(handle)

    return let(strip_chars(clean_text(x), "@ "), of)


def is_directory(x: Column | str) -> Column:
    return F.coalesce(url_domain(x).rlike(_quoted(DIRECTORY_MARKERS)), F.lit(False))


def is_public_url(x: Column | str) -> Column:
    """An http(s) URL that names a public place: no user data, default ports, no local names and no private or reserved
    addresses. Names are not looked up."""

    def parts(u: Column) -> Column:
        authority = _part(u, 2)
        host = F.when(authority.startswith("["), F.regexp_extract(authority, r"^\[([^\]]*)\]", 1)).otherwise(F.rtrim(_host(authority), F.lit(".")))
        return F.struct(u.alias("url"), F.lower(_part(u, 1)).alias("scheme"), authority.alias("authority"), F.lower(host).alias("host"), F.regexp_extract(authority, r":([0-9]+)$", 1).alias("port"))

    def private_v4(host: Column) -> Column:
        o = [F.try_element_at(F.split(host, r"\."), F.lit(k + 1)).try_cast("int") for k in range(3)]
        return (
            o[0].isin(0, 10, 127) | (o[0] >= 224) | ((o[0] == 172) & o[1].between(16, 31)) | ((o[0] == 192) & (o[1] == 168))
            | ((o[0] == 169) & (o[1] == 254)) | ((o[0] == 100) & o[1].between(64, 127)) | ((o[0] == 198) & o[1].isin(18, 19))
            | ((o[0] == 192) & (o[1] == 0) & o[2].isin(0, 2)) | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100)) | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
        )

    def judged(s: Column) -> Column:
        host = s["host"]
        local = (host == "localhost") | host.endswith(".localhost") | host.endswith(".local") | host.endswith(".internal")
        fine = (
            s["scheme"].isin("http", "https") & (host != "") & ~s["authority"].contains("@") & s["port"].isin("", "80", "443")
            & ~s["url"].contains("\\") & ~s["url"].rlike(r"[\x00-\x1F]") & ~local
        )
        public_v6 = host.rlike("^[23][0-9a-f]{3}:") & ~host.rlike("^(2001:(db8|0?2|0?10|1[0-9a-f]|2[0-9a-f]|0{0,3}:)|2002:|3fff:)")
        where = F.when(s["authority"].startswith("["), public_v6).when(host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ~F.coalesce(private_v4(host), F.lit(True))).otherwise(True)
        return fine & where

    return F.coalesce(let(let(x, parts), judged), F.lit(False))
