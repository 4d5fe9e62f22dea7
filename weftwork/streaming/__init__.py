"""The stateless operators over files that keep arriving."""
