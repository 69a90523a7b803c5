"""Stateful operators: small steps, their batch form and their streaming form."""
