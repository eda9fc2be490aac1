"""The models: staging, intermediate, core, product and executive."""
