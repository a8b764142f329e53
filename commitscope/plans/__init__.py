"""Plan-level helpers (join strategy choices) and the composed jobs:
commit plans (OP-36/37) and the end-to-end generation job (OP-39)."""
