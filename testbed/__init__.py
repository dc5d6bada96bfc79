"""The engine's operators wired to the generated tables, each with its SQL twin."""
