"""Errors of the engine's API."""


class SearchError(ValueError):
    """code: INVALID_REGEX, INVALID_INPUT, UNSUPPORTED_REGEX or INDEX_NOT_READY."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message
