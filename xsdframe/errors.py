"""The library's exception."""


class XsdFrameError(Exception):
    """A schema, a document or a call that cannot be worked with.

    code: a short stable name such as `no-schema-root`; file: where, if known.
    """

    def __init__(self, message: str, code: str = "error", file: str | None = None):
        super().__init__(message)
        self.code, self.file = code, file

    def line(self) -> str:
        """All of it in one line, as the command line prints it."""
        return f"{self.code}: {self}" + (f" ({self.file})" if self.file else "")
