"""See the README for what each module holds."""
