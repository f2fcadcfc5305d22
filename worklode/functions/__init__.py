"""worklode subpackage."""
