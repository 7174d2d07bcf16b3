from tablewash.plans.recipe import Recipe, Step, clean_table, run_clean, run_recipe

__all__ = ["Recipe", "Step", "clean_table", "run_clean", "run_recipe"]
