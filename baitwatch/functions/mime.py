"""The two MIME steps that need a real message parser. Both are Arrow-batched
and receive NULL for every row that native tests already settled."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .headers import MAY_HAVE_FILENAME, body_of, header, header_block

# The functions sent to the workers are closures without references to this
# package, so executors need no copy of it.


def _filenames_udf():
    def filenames(raw: str) -> list[str]:
        from email import message_from_string

        names = (part.get_filename() for part in message_from_string(raw).walk())
        return [str(n) for n in names if n]

    def per_batch(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: [] if r is None else filenames(r))

    return F.pandas_udf(per_batch, T.ArrayType(T.StringType()))


def _text_part_udf():
    def text_part(raw: str) -> str:
        from email import message_from_string

        message = message_from_string(raw)
        for part in message.walk():
            if message.is_multipart() and part.get_content_type() != "text/plain":
                continue
            payload = part.get_payload(decode=True)
            if payload:
                return payload.decode("utf-8", errors="replace")
        return "" if message.is_multipart() else str(message.get_payload())

    def per_batch(raw: pd.Series) -> pd.Series:
        return raw.map(lambda r: None if r is None else text_part(r))

    return F.pandas_udf(per_batch, T.StringType())


def attachment_names(raw: Column) -> Column:
    """File names of all parts of a message, in order; contents stay unread."""
    return _filenames_udf()(F.when(raw.rlike(MAY_HAVE_FILENAME), raw))


def message_body(raw: Column) -> Column:
    """First text/plain part; plain single-part messages never leave the JVM."""
    block = header_block(raw)
    kind = F.lower(header(block, "Content-Type"))
    encoding = F.lower(header(block, "Content-Transfer-Encoding"))
    plain = ~(kind.startswith("multipart/") | kind.startswith("message/")) & (
        encoding.isin("", "7bit", "8bit", "binary"))
    return F.coalesce(_text_part_udf()(F.when(~plain, raw)), body_of(raw))
