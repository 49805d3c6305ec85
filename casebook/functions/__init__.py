"""casebook package."""
