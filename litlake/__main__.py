from litlake.pipeline import main

main()
