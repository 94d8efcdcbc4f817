"""cloakframe: PII detection, pseudonymisation and restoration as DataFrame plans."""

__version__ = "0.1.0"
