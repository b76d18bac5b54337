"""The engine's operators applied to the tables of a folder, one registered query each."""

from stepwell.queries import core, deck, language, load, plans, reader, scoring  # noqa: F401
