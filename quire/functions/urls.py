"""Functions of addresses and file names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = "^[A-Za-z][A-Za-z0-9+.-]+:"
OPENABLE = r"(?i)^(https?://|mailto:|tel:)\S"


def external(uri: Column) -> Column:
    """Whether a text begins with a scheme of two characters or more."""
    return uri.rlike(SCHEME)


def openable(uri: Column) -> Column:
    return uri.rlike(OPENABLE)


def extension_openable(uri: Column) -> Column:
    return uri.rlike("(?i)^(https?|file):")


def pdf_url(url: Column) -> Column:
    """Whether the path ends in .pdf, in any case."""
    return F.lower(F.regexp_replace(url, "[?#].*$", "")).like("%.pdf")


def pdf_response(content_type: Column, disposition: Column) -> Column:
    attached = F.coalesce(F.lower(F.trim(disposition)).like("attachment%"), F.lit(False))
    return F.coalesce(F.lower(content_type).like("%application/pdf%"), F.lit(False)) & ~attached


def document_key(url: Column) -> Column:
    """file: or url: and the address without its fragment, scheme and host in lower case, `/` for an empty path, default
    ports dropped; what is no address stays as given."""
    bare = F.substring_index(url, "#", 1)
    scheme = F.lower(F.regexp_extract(bare, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    rest = F.regexp_replace(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    whole = F.when(scheme == "", bare).otherwise(F.concat(scheme, F.lit("://"), host, rest))
    return F.when(whole.startswith("file:"), whole).otherwise(F.concat(F.lit("url:"), whole))


def local_key(name: Column, size: Column) -> Column:
    return F.concat(F.lit("local:"), F.lower(F.trim(name)), F.lit(":"), size.cast("string"))


def file_name(url: Column) -> Column:
    """The last part of the path, decoded."""
    path = F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")
    return F.coalesce(F.try_url_decode(F.substring_index(path, "/", -1)), F.substring_index(path, "/", -1))


def with_pdf(name: Column) -> Column:
    return F.when(F.lower(name).like("%.pdf"), name).otherwise(F.concat(name, F.lit(".pdf")))


def without_scheme(url: Column) -> Column:
    return F.regexp_replace(url, "^(?i)[a-z][a-z0-9+.-]*://", "")
