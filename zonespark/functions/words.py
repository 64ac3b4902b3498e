"""Text rules for code inside tasks; the column versions are in functions/text.py."""

import re

from zonespark.functions.text import MAX_TEXT, WHITE_CODES

_RUN = re.compile("[" + "".join(map(chr, WHITE_CODES)) + "]+")


def collapse_text(text: str) -> str:
    return _RUN.sub(" ", text).strip(" ")[:MAX_TEXT]
