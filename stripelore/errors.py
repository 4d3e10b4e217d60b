"""Errors of reading ORC files."""


class OrcError(Exception):
    """Any of the errors below."""


class InvalidStripeIndex(OrcError, IndexError):
    """A stripe was asked for that the file does not have."""


class UnexpectedEof(OrcError, EOFError):
    """The file or a stream ends early."""


class InvalidTail(OrcError, ValueError):
    """Postscript, footer or their lengths do not fit the file."""


class UnsupportedFeature(OrcError, NotImplementedError):
    """The file uses something that is not read here, such as encryption or an unknown codec."""


class CorruptedProtobuf(OrcError, ValueError):
    """A metadata message cannot be decoded."""


class MalformedStream(OrcError, ValueError):
    """A stream reaches beyond its stripe or has blocks of impossible lengths."""


class MalformedRleBlock(OrcError, ValueError):
    """A run-length block is cut short or has an impossible header."""


class InvalidStreamKind(OrcError, KeyError):
    """A column has no stream of the kind that was asked for."""


class ColumnLengthNotEqual(OrcError, ValueError):
    """Columns of one batch have different lengths."""


class MalformedPresentOrData(OrcError, ValueError):
    """The presence bits and the values of a column do not fit together."""


class MalformedDictionary(OrcError, ValueError):
    """A dictionary's lengths, bytes or indexes do not fit together."""


class TypeNotSupported(OrcError, TypeError):
    """A column type that has no counterpart here."""


class UnsupportedUnion(OrcError, TypeError):
    """A union with more variants than a tag can tell apart."""


class MalformedUnion(OrcError, ValueError):
    """A union's tag names no variant."""


class UnsupportedDecimal(OrcError, TypeError):
    """A decimal beyond 38 digits."""


class InvalidSchema(OrcError, ValueError):
    """The list of types is not a tree of types."""
