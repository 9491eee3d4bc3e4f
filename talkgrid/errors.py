"""Errors. A wrong pairing of inputs is fatal and raises; one bad item is a null."""


class TalkgridError(Exception):
    """Base of all errors raised here."""


class MediaLoadError(TalkgridError):
    """Audio or video can't be read."""


class TranscribeError(TalkgridError):
    """Speech recognition failed."""


class DiarizeError(TalkgridError):
    """Speaker separation failed."""


class DictionaryError(TalkgridError):
    """A glossary or corrections file is missing, malformed or contradictory."""


class CrosscheckError(TalkgridError):
    """Crosscheck input is missing or malformed, or transcript and captions don't belong together."""
