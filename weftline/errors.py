"""Refusals. A request that cannot be answered faithfully fails by name, never by default."""


class Refused(ValueError):
    """The request is not allowed as stated."""


class UnknownField(Refused):
    """A name that the schema does not declare."""
