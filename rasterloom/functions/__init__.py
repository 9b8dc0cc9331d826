"""Functions of the library; see README.md."""
