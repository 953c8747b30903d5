"""Plans: commands to plans over a store, and the catalogue of registered queries."""
