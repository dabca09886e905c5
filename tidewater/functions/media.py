"""Media urls, types, keys and signatures as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
VIDEO_EXTENSIONS = [".mp4", ".webm", ".mov", ".avi"]
MEDIA_HOSTS = ["i.redd.it", "i.imgur.com", "imgur.com", "v.redd.it", "gfycat.com", "redgifs.com", "giphy.com", "media.giphy.com", "i.giphy.com"]
GIF_HOSTS = ["gfycat.com", "redgifs.com", "giphy.com"]
MAX_BYTES, MIN_BYTES = 50 * 1024 * 1024, 100


def host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def _ends(c: Column, extensions: list[str]) -> Column:
    out = F.lit(False)
    for e in extensions:
        out = out | c.endswith(e)
    return out


def _holds(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | c.contains(p)
    return out


def media_type(url: Column) -> Column:
    """image, gif or video; null for an address that is no media. Hosts match as a part of the host's text."""
    h, p, low = host(url), path(url), F.lower(path(url))
    by_extension = F.when(_ends(low, IMAGE_EXTENSIONS), F.when(low.contains(".gif"), "gif").otherwise("image")).when(_ends(low, VIDEO_EXTENSIONS), F.lit("video"))
    by_host = F.when(h.contains("imgur.com") & ~_ends(p, [".jpg", ".png", ".gif"]), "image").when(h.contains("v.redd.it"), "video").when(_holds(h, GIF_HOSTS), "gif")
    return F.when(F.length(url) > 0, F.coalesce(by_extension, F.when(_holds(h, MEDIA_HOSTS), by_host)))


def is_media(url: Column) -> Column:
    return media_type(url).isNotNull()


def file_extension(url: Column, kind: Column) -> Column:
    found = F.lower(F.regexp_extract(path(url), r"[^/.][^/]*?(\.[^./]*)$", 1))
    by_kind = F.when(kind == "gif", ".gif").when(kind == "video", ".mp4").otherwise(".jpg")
    return F.when(found.isin(IMAGE_EXTENSIONS + VIDEO_EXTENSIONS), found).otherwise(by_kind)


def content_type(extension: Column) -> Column:
    return (
        F.when(extension == ".png", "image/png").when(extension == ".gif", "image/gif").when(extension == ".webp", "image/webp")
        .when(extension == ".mp4", "video/mp4").when(extension.isin(VIDEO_EXTENSIONS), "video/webm").otherwise("image/jpeg")
    )


def object_key(group: Column, kind: Column, filename: Column, prefix: Column | None = None) -> Column:
    return F.concat_ws("/", F.lit("reddit"), F.nullif(prefix, F.lit("")) if prefix is not None else F.lit(None).cast("string"), group, F.concat(kind, F.lit("s")), filename)


def valid_type(kind: Column, mime: Column) -> Column:
    """Whether the content's true MIME type is what the item says it is."""
    return F.coalesce(
        ((kind == "image") & mime.startswith("image/") & (mime != "image/gif")) | ((kind == "gif") & (mime == "image/gif")) | ((kind == "video") & mime.startswith("video/")),
        F.lit(False),
    )


def target_format(kind: Column) -> Column:
    return F.when(kind == "image", "jpeg").when(kind.isin("gif", "video"), "mp4")


def processed_key(key: Column, fmt: Column) -> Column:
    """processed_media/<folder>/<name without its extension>.<format>."""
    return F.concat(F.lit("processed_media/"), F.regexp_replace(key, r"(?<=[^/])\.[^./]*$", ""), F.lit("."), fmt)


def object_url(bucket: str, key: Column) -> Column:
    return F.concat(F.lit(f"s3a://{bucket}/"), key)


def sniff_mime(content: Column) -> Column:
    """True MIME type from the first bytes; null for anything else."""
    head = F.hex(F.substring(content, 1, 16))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "41564920"), "video/x-msvideo")
        .when(F.substring(head, 9, 8) == "66747970", "video/mp4").when(head.startswith("1A45DFA3"), "video/webm")
    )


def large_enough(content: Column) -> Column:
    return F.coalesce(F.octet_length(content) >= MIN_BYTES, F.lit(False))


def gallery_urls(metadata: Column) -> Column:
    """Addresses of a gallery's items of kind Image, from a map of id to struct(e, s.u)."""
    items = F.filter(F.map_values(metadata), lambda x: F.coalesce((x["e"] == "Image") & (F.length(x["s"]["u"]) > 0), F.lit(False)))
    return F.coalesce(F.transform(items, lambda x: x["s"]["u"]), F.array().cast("array<string>"))


def media_item(url: Column, kind: Column, group: Column, bucket: str = "landing-zone") -> Column:
    """What is stored about one item before processing; the file is named after a hash of its address."""
    extension = file_extension(url, kind)
    filename = F.concat(F.substring(F.sha2(url, 256), 1, 32), extension)
    return F.struct(
        kind.alias("media_type"), object_url(bucket, object_key(group, kind, filename)).alias("lz_url"), url.alias("source_url"),
        filename.alias("filename"), content_type(extension).alias("content_type"),
    )


def post_media(url: Column, is_self: Column, gallery: Column, group: Column) -> Column:
    """Direct and gallery items of a post in one array; null if there are none."""
    empty = F.array().cast("array<struct<media_type:string,lz_url:string,source_url:string,filename:string,content_type:string>>")
    direct = F.when(is_media(url) & ~F.coalesce(is_self, F.lit(False)), F.array(media_item(url, media_type(url), group))).otherwise(empty)
    items = F.concat(direct, F.transform(gallery_urls(gallery), lambda u: media_item(u, F.lit("image"), group)))
    return F.when(F.size(items) > 0, items)
